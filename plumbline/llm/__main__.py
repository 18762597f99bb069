"""As ``python -m plumbline``, for the queries of the nine problems."""

from plumbline.__main__ import main
from plumbline.llm.queries import QUERIES

if __name__ == "__main__":
    raise SystemExit(main(queries=QUERIES))
