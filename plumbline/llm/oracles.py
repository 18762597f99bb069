"""DuckDB SQL for those queries of the nine problems that SQL can express."""

from __future__ import annotations

from plumbline.llm import mixing, nested_sample
from plumbline.llm.queries import DRAWS, SEED
from plumbline.plans.dialect import bits, cat, key, sha, words


def _near(left: str, right: str, extra: str, columns: str) -> str:
    """Numbers at most 3 bits apart agree in one of four 16-bit blocks."""
    return " UNION ".join(
        f"SELECT {columns} FROM {left} l JOIN {right} r ON {extra} ((l.b >> {16 * i}) & 65535) = ((r.b >> {16 * i}) & 65535) AND bit_count(xor(l.b, r.b)::BIT) <= 3" for i in range(4)
    )


def _number(*parts: str) -> str:
    text = " || chr(31) || ".join([f"'{SEED}'", *parts])
    return f"CAST(('0x' || substr(sha256({text}), 1, 12)) AS BIGINT)"


_MONET_NEAR = _near("monet_bits", "monet_bits", "", "l.k AS ka, r.k AS kb")

#: A picture's name in one spelling, as ``picture_names`` says in Python; marks and extensions are taken off three times at most.
_DECODED = "url_decode(url_decode(url_decode(file_name)))"
_PATH = f"""regexp_replace(regexp_replace(regexp_replace(lower(replace(trim({_DECODED}), chr(92), '/')), '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '^(\\./|/)+', '')"""


def _bare(stem: str) -> str:
    for _ in range(3):
        for pattern in (r"\.(?:jpe?g|jpe|jfif|png|webp|gif|bmp|tiff?|heic|heif|avif|img)$", r"^(?:copy(?:[ _-]*\(?\d+\)?)?[ _-]+of|kopie[ _-]+von|copie[ _-]+de)[ _-]+", r"(?:[ _-]*\(\d+\)|[ _-]+\(?(?:copy|kopie|copie)(?:[ _-]*\(?\d+\)?)?\)?|~\d*)$"):
            stem = f"trim(regexp_replace({stem}, '{pattern}', ''))"
    return f"regexp_replace(regexp_replace({stem}, '[\\s_.,+-]+', '-', 'g'), '^-|-$', '', 'g')"


P1_FOUND = f"""
WITH s AS (SELECT {key('sample_id')} AS k, min(batch_id) AS batch FROM samples GROUP BY 1),
sd AS (SELECT DISTINCT {key('sample_id')} AS k, unnest([{sha('content_sha256')}, {sha('upstream_sha256')}]) AS v FROM samples),
m AS (SELECT "__key__" AS k, min(batch_id) AS batch FROM monet_rows GROUP BY 1),
md AS (SELECT DISTINCT "__key__" AS k, {sha('hash_sha256')} AS v FROM monet_rows),
monet_bits AS (SELECT DISTINCT "__key__" AS k, {bits('hash_perceptual')} AS b FROM monet_rows WHERE ({bits('hash_perceptual')}) IS NOT NULL),
n AS ({_MONET_NEAR}),
i AS (SELECT file_name AS k, min(batch_id) AS batch FROM mirage_rows GROUP BY 1),
ip AS (SELECT k, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(p, '([^/]*)$', 1) AS stem FROM (SELECT DISTINCT file_name AS k, {_PATH} AS p FROM mirage_rows WHERE trim(file_name) <> '')),
id AS (SELECT k, folder || '/' || {_bare('stem')} AS v FROM ip),
p AS (SELECT 'sample' AS kind, a.k AS ka, b.k AS kb FROM sd a JOIN sd b ON a.v = b.v AND a.k < b.k
 UNION SELECT 'monet', a.k, b.k FROM md a JOIN md b ON a.v = b.v AND a.k < b.k
 UNION SELECT 'monet', ka, kb FROM n WHERE ka < kb
 UNION SELECT 'mirage', a.k, b.k FROM id a JOIN id b ON a.v = b.v AND a.k < b.k),
r AS (SELECT 'sample' AS kind, * FROM s UNION ALL SELECT 'monet', * FROM m UNION ALL SELECT 'mirage', * FROM i)
SELECT DISTINCT p.kind AS record_kind, p.ka AS key_a, p.kb AS key_b FROM p JOIN r x ON x.kind = p.kind AND x.k = p.ka JOIN r y ON y.kind = p.kind AND y.k = p.kb
JOIN batches b ON b.batch_id = greatest(x.batch, y.batch) WHERE x.batch <> y.batch AND {key('b.state')} = 'new'
"""

_RECORDS = f"""r AS (SELECT record_kind, record_key, min(batch_id) AS batch FROM (SELECT 'sample' AS record_kind, {key('sample_id')} AS record_key, batch_id FROM samples UNION ALL SELECT 'group', {key('provenance_group')}, batch_id FROM samples UNION ALL SELECT 'monet', {key('"__key__"')}, batch_id FROM monet_rows) GROUP BY 1, 2),
b AS (SELECT *, ({_number('record_kind', 'record_key')} % {nested_sample.BUCKETS} * {nested_sample.STRIDE} + {nested_sample.OFFSET}) % {nested_sample.BUCKETS} AS bucket_place FROM r WHERE record_key IS NOT NULL)"""
_LISTED = [(i, last, nested_sample.listed(share)) for i, (last, share) in enumerate(DRAWS, 1)]

#: Components of groups that samples tie together, and the split that rendezvous hashing gives each sample under each manifest.
_ASSIGNED = f"""m AS (SELECT DISTINCT {key('sample_id')} AS k, {key('provenance_group')} AS g FROM samples WHERE {key('sample_id')} IS NOT NULL),
ed AS (SELECT DISTINCT a.g AS x, b.g AS y FROM m a JOIN m b ON a.k = b.k WHERE a.g <> b.g),
re(x, y) AS (SELECT DISTINCT g, g FROM m WHERE g IS NOT NULL UNION SELECT re.x, ed.y FROM re JOIN ed ON ed.x = re.y),
co AS (SELECT x AS g, min(y) AS component FROM re GROUP BY 1),
of AS (SELECT k, coalesce(min(component), 'alone' || chr(31) || k) AS component FROM m LEFT JOIN co USING (g) GROUP BY k),
ra AS (SELECT split_manifest_id, seed, unnest(map_entries(ratios)) AS e FROM split_manifests),
sc AS (SELECT split_manifest_id, component, e.key AS split, e.value / -ln((CAST(('0x' || substr(sha256(seed || chr(31) || e.key || chr(31) || component), 1, 12)) AS BIGINT) + 0.5e0) / 281474976710656e0) AS score FROM ra, (SELECT DISTINCT component FROM of) WHERE e.value > 0),
wi AS (SELECT split_manifest_id, component, arg_max(split, score) AS split FROM sc GROUP BY 1, 2),
asg AS (SELECT split_manifest_id, k AS sample_id, split FROM of JOIN wi USING (component))"""

#: Assigned records and their values, on both sides.
_SIDES = f"""k AS (SELECT {key('sample_id')} AS s, min({cat('source_id')}) AS source FROM samples GROUP BY 1),
a AS (SELECT DISTINCT split_manifest_id AS m, {key('sample_id')} AS s, {cat('split')} AS split FROM split_assignments WHERE split_manifest_id IS NOT NULL AND {cat('split')} IN ('train', 'validation', 'calibration') AND {key('sample_id')} IN (SELECT s FROM k)),
x AS (SELECT DISTINCT {key("'monet:' || \"__key__\"")} AS s, {bits('hash_perceptual')} AS b, sscd_cluster_id AS v FROM monet_rows),
v AS (SELECT DISTINCT 'content' AS how, {key('sample_id')} AS s, {sha('content_sha256')} AS v FROM samples UNION SELECT 'cluster', s, v FROM x UNION SELECT 'perceptual', s, b::VARCHAR FROM x),
el AS (SELECT DISTINCT m, how, s, v FROM a JOIN v USING (s) WHERE split <> 'train' AND v IS NOT NULL),
tl AS (SELECT DISTINCT m, how, s, v FROM a JOIN v USING (s) WHERE split = 'train' AND v IS NOT NULL),
e AS (SELECT m, s, v::UBIGINT AS b, v FROM el WHERE how = 'perceptual'), t AS (SELECT m, s, v::UBIGINT AS b, v FROM tl WHERE how = 'perceptual')"""

_AT = f"list_transform(range(cap), lambda j: CAST(ceil(least(1e0, list_sum(list_transform(range(j + 1), lambda t: exp(t * ln({{}}) - {{}} - lgamma(t + 1))))) * {mixing.BINS}) AS BIGINT))"
_TAKEN = "CAST(sum(size * len(list_filter({}, lambda x: bin >= x))) AS BIGINT)"
#: Mixtures: the mean of each target by halving an interval, the limits of its copies, and the copies.
_MIXED = f"""w AS (SELECT doc_id, {cat('source')} AS source, {words('text')} AS size FROM documents WHERE {cat('source')} IS NOT NULL AND {words('text')} > 0),
go AS (SELECT t.mixture_id, {cat('t.source')} AS source, target_share, CAST(max_repeats AS INT) AS cap, budget_words AS budget, target_share * budget_words AS wanted, coalesce((SELECT CAST(sum(size) AS BIGINT) FROM w WHERE w.source = {cat('t.source')}), 0) AS available FROM mix_targets t JOIN mixtures USING (mixture_id)),
it AS (SELECT mixture_id, source, doc_id, size, {_number('mixture_id', 'CAST(doc_id AS VARCHAR)')} // {2 ** (48 - mixing.BITS)} AS bin FROM w JOIN go USING (source)),
bs(i, mixture_id, source, low, high) AS (SELECT 0, mixture_id, source, 0e0, 1073741824e0 FROM go WHERE wanted > 0 AND wanted < cap * available UNION ALL
 SELECT i + 1, mixture_id, source, CASE WHEN got < wanted THEN mid ELSE low END, CASE WHEN got < wanted THEN high ELSE mid END FROM
 (SELECT i, c.mixture_id, c.source, low, high, mid, wanted, {_TAKEN.format("lim")} AS got FROM (SELECT bs.*, wanted, (low + high) / 2 AS mid, {_AT.format('((low + high) / 2)', '((low + high) / 2)')} AS lim FROM bs JOIN go USING (mixture_id, source) WHERE i < 90) c JOIN it USING (mixture_id, source) GROUP BY ALL)),
en AS (SELECT mixture_id, source, wanted, {_AT.format('low', 'low')} AS below, {_AT.format('high', 'high')} AS above FROM bs JOIN go USING (mixture_id, source) WHERE i = 90),
ch AS (SELECT mixture_id, source, CASE WHEN wanted - {_TAKEN.format('below')} < {_TAKEN.format('above')} - wanted THEN below ELSE above END AS limits FROM en JOIN it USING (mixture_id, source) GROUP BY mixture_id, source, wanted, below, above),
cp AS (SELECT it.*, CAST(CASE WHEN wanted <= 0 THEN 0 WHEN wanted >= cap * available THEN cap ELSE len(list_filter(limits, lambda x: bin >= x)) END AS INT) AS copies FROM it JOIN go USING (mixture_id, source) LEFT JOIN ch USING (mixture_id, source)),
tk AS (SELECT * FROM cp WHERE copies > 0)"""

ORACLES = {
    "p1_found": P1_FOUND,
    "p2_found": f"""
WITH d AS (SELECT DISTINCT draw_id, run_no, {key('record_kind')} AS record_kind, {key('record_key')} AS record_key FROM draws WHERE draw_id IS NOT NULL AND run_no IS NOT NULL),
runs AS (SELECT DISTINCT draw_id, run_no FROM d),
known AS (SELECT * FROM d WHERE record_kind IS NOT NULL AND record_key IS NOT NULL)
SELECT DISTINCT k.record_kind, k.record_key FROM known k JOIN runs r ON r.draw_id > k.draw_id OR (r.draw_id = k.draw_id AND r.run_no <> k.run_no)
WHERE NOT EXISTS (SELECT 1 FROM known o WHERE o.draw_id = r.draw_id AND o.run_no = r.run_no AND o.record_kind = k.record_kind AND o.record_key = k.record_key)
""",
    "p2_nested_sample": f"""
WITH {_RECORDS} SELECT record_kind, record_key, CAST(bucket_place AS BIGINT) AS bucket_place FROM b WHERE bucket_place < {nested_sample.listed(0.05)}
""",
    "p2_growth": f"""
WITH {_RECORDS} {' UNION ALL '.join(f'SELECT CAST({i} AS INT) AS draw, CAST({n} AS INT) AS listed, count(*) AS records, CAST(0 AS BIGINT) AS lost FROM b WHERE batch <= {last} AND bucket_place < {n}' for i, last, n in _LISTED)}
""",
    "p3_found": f"""
WITH i AS (SELECT {cat('source')} AS source, sscd_cluster_id, "__key__" AS monet_key, max(aesthetic_score) AS score FROM monet_rows
 WHERE {cat('source')} IS NOT NULL AND sscd_cluster_id IS NOT NULL AND "__key__" IS NOT NULL AND aesthetic_score IS NOT NULL AND NOT isnan(aesthetic_score) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source, sscd_cluster_id ORDER BY score DESC, monet_key) AS rn, count(*) OVER (PARTITION BY source, sscd_cluster_id) AS n FROM i)
SELECT source, sscd_cluster_id, monet_key FROM r WHERE rn <= 3 AND n > 3
""",
    "p4_found": f"""
WITH s AS (SELECT DISTINCT {key('sample_id')} AS k, {cat('source_id')} AS source_id, {cat('generator_family')} AS g, {cat('content_type')} AS c, label FROM samples),
n AS (SELECT source_id, g, c, label, count(*) AS n FROM s WHERE k IS NOT NULL AND source_id IS NOT NULL AND c IS NOT NULL AND label IS NOT NULL GROUP BY ALL)
SELECT t.target_id FROM sample_targets t LEFT JOIN n ON n.source_id = {cat('t.source_id')} AND n.g IS NOT DISTINCT FROM {cat('t.generator_family')} AND n.c = {cat('t.content_type')} AND n.label = t.label
WHERE coalesce(n.n, 0) < t.target_share * t.sample_size OR coalesce(n.n, 0) < t.min_records
""",
    "p4_unmet": f"""
WITH s AS (SELECT DISTINCT {key('sample_id')} AS k, {cat('source_id')} AS source_id, {cat('generator_family')} AS g, {cat('content_type')} AS c, label FROM samples),
n AS (SELECT source_id, g, c, label, count(*) AS n FROM s WHERE k IS NOT NULL AND source_id IS NOT NULL AND c IS NOT NULL AND label IS NOT NULL GROUP BY ALL)
SELECT t.target_id, t.target_set, round(t.target_share * t.sample_size, 6) AS wanted, coalesce(t.min_records, 0) AS min_records, coalesce(n.n, 0) AS available, round(greatest(greatest(t.target_share * t.sample_size, t.min_records) - coalesce(n.n, 0), 0), 6) AS unmet, TRUE AS within
FROM sample_targets t LEFT JOIN n ON n.source_id = {cat('t.source_id')} AND n.g IS NOT DISTINCT FROM {cat('t.generator_family')} AND n.c = {cat('t.content_type')} AND n.label = t.label
""",
    # Both sets can be filled here, so each comes out whole and without repeats.
    "p4_drawn": f"""
WITH s AS (SELECT DISTINCT {key('sample_id')} AS k, {cat('source_id')} AS source_id, {cat('generator_family')} AS g, {cat('content_type')} AS c, label FROM samples WHERE {key('sample_id')} IS NOT NULL),
n AS (SELECT t.target_set, count(*) AS available FROM s JOIN sample_targets t ON s.source_id = {cat('t.source_id')} AND s.g IS NOT DISTINCT FROM {cat('t.generator_family')} AND s.c = {cat('t.content_type')} AND s.label = t.label GROUP BY 1)
SELECT target_set, sample_size, available, least(sample_size, available) AS quota, least(sample_size, available) AS drawn, least(sample_size, available) AS distinct_keys FROM (SELECT target_set, max(sample_size) AS sample_size FROM sample_targets GROUP BY 1) JOIN n USING (target_set)
""",
    "p5_found": f"""
WITH m AS (SELECT DISTINCT {key('sample_id')} AS k, {key('provenance_group')} AS g FROM samples),
a AS (SELECT DISTINCT split_manifest_id, {key('sample_id')} AS k, {cat('split')} AS split FROM split_assignments)
SELECT split_manifest_id, g AS provenance_group FROM a JOIN m USING (k) WHERE g IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1
""",
    "p5_assignments": f"WITH RECURSIVE {_ASSIGNED} SELECT * FROM asg",
    "p5_balance": f"""
WITH RECURSIVE {_ASSIGNED}, n AS (SELECT split_manifest_id, split, count(*) AS n FROM asg GROUP BY 1, 2), al AS (SELECT split_manifest_id, sum(n) AS total FROM n GROUP BY 1)
SELECT split_manifest_id, e.key AS split, e.value AS ratio, coalesce(n, 0) AS n, coalesce(n, 0) / total AS share FROM ra JOIN al USING (split_manifest_id) LEFT JOIN n ON n.split_manifest_id = ra.split_manifest_id AND n.split = e.key
""",
    "p6_found": f"""
WITH {_SIDES},
p AS (SELECT l.m, l.s AS es, r.s AS ts FROM el l JOIN tl r ON l.m = r.m AND l.how = r.how AND l.v = r.v UNION {_near('e', 't', 'l.m = r.m AND', 'l.m, l.s, r.s')})
SELECT DISTINCT m AS split_manifest_id, least(es, ts) AS sample_a, greatest(es, ts) AS sample_b FROM p WHERE es <> ts
""",
    "p6_counts": f"""
WITH {_SIDES},
p AS (SELECT l.m, l.how, l.s AS es, r.s AS ts, l.v AS ev, r.v AS tv FROM el l JOIN tl r ON l.m = r.m AND l.how = r.how AND l.v = r.v UNION {_near('e', 't', 'l.m = r.m AND', "l.m, 'perceptual', l.s, r.s, l.v, r.v")})
SELECT p.m AS split_manifest_id, a.split, k.source, p.how, count(DISTINCT p.es) AS samples, count(*) AS links FROM p JOIN a ON a.m = p.m AND a.s = p.es AND a.split <> 'train' JOIN k ON k.s = p.es WHERE p.es <> p.ts GROUP BY ALL
""",
    "p7_found": f"""
SELECT container_class, doc_id FROM documents JOIN containers ON {words('text')} > capacity_words WHERE doc_id IS NOT NULL
""",
    "p7_audit": f"""
WITH w AS (SELECT doc_id, max({words('text')}) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT container_class, count(*) AS documents, CAST(sum(ceil(n / capacity_words)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS words, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS overfull FROM w, containers WHERE n > 0 GROUP BY 1
""",
    "p8_audit": f"""
WITH w AS (SELECT {cat('source')} AS source, sum({words('text')}) AS n FROM documents GROUP BY 1)
SELECT t.mixture_id, {cat('t.source')} AS source, CAST(coalesce(w.n, 0) AS BIGINT) AS available, round(t.target_share * x.budget_words, 6) AS wanted, t.target_share * x.budget_words > t.max_repeats * coalesce(w.n, 0) AS short, TRUE AS cap_kept, TRUE AS size_right
FROM mix_targets t JOIN mixtures x USING (mixture_id) LEFT JOIN w ON w.source = {cat('t.source')}
""",
    "p8_mixture": f"""
WITH RECURSIVE {_MIXED} SELECT mixture_id, source, doc_id, size, CAST(copy AS INT) AS copy, {_number("'order'", 'mixture_id', 'CAST(doc_id AS VARCHAR)', 'CAST(copy AS VARCHAR)')} AS place FROM tk, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy)
""",
    "p8_shares": f"""
WITH RECURSIVE {_MIXED}, su AS (SELECT mixture_id, source, CAST(sum(size * copies) AS BIGINT) AS taken, count(*) AS documents, max(copies) AS most_copies, max(size) AS largest FROM tk GROUP BY 1, 2), wh AS (SELECT mixture_id, sum(taken) AS whole FROM su GROUP BY 1)
SELECT go.mixture_id, go.source, target_share, cap AS max_repeats, budget, available, wanted, wanted > cap * available AS short, coalesce(taken, 0) AS taken, coalesce(documents, 0) AS documents, coalesce(most_copies, 0) AS most_copies, coalesce(largest, 0) AS largest, CASE WHEN whole > 0 THEN coalesce(taken, 0) / whole ELSE 0e0 END AS share
FROM go LEFT JOIN su ON su.mixture_id = go.mixture_id AND su.source = go.source LEFT JOIN wh ON wh.mixture_id = go.mixture_id
""",
    "p8_found": f"""
WITH w AS (SELECT {cat('source')} AS source, sum({words('text')}) AS n FROM documents GROUP BY 1)
SELECT t.mixture_id, {cat('t.source')} AS source FROM mix_targets t JOIN mixtures x USING (mixture_id) LEFT JOIN w ON w.source = {cat('t.source')}
WHERE t.target_share * x.budget_words > t.max_repeats * coalesce(w.n, 0)
""",
}
