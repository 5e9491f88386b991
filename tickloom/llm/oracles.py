"""The operators' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


MIX = f"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS place, len({_words(SPACED, False)})::bigint AS size FROM documents
), sources AS (
    SELECT source, sum(size)::bigint AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w
    FROM sized GROUP BY source
), filling AS (
    SELECT *, 2 * source_size AS cap,
        1.5::double * sum(source_size) OVER () AS budget,
        coalesce(sum(2 * source_size) OVER before, 0) AS cap_before, sum(w) OVER (ORDER BY 2 * source_size / w DESC, source DESC) AS w_left
    FROM sources
    WINDOW before AS (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
    SELECT *, (budget - cap_before) / w_left AS level, cap > (budget - cap_before) / w_left * w AS open FROM filling
), edge AS (
    SELECT first(level ORDER BY cap / w, source) AS level FROM levels WHERE open
), targets AS (
    SELECT source, source_size, (CASE WHEN edge.level IS NULL OR cap <= w * edge.level THEN cap ELSE w * edge.level END)::double AS target
    FROM levels, edge
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)))::bigint AS taken
FROM placed
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words(ALNUM, True)} AS w FROM documents),
b AS (SELECT item_id::varchar AS item, {_words(ALNUM, True)} AS w FROM benchmark),
phrases AS (
    SELECT item, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS phrase
    FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM phrases),
places AS (
    SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
    FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)
), found AS (SELECT doc_id, p.k, i, item FROM places p JOIN phrases q ON p.k = q.k AND p.phrase = q.phrase),
hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(hits.n, 0)::bigint AS n_hit, coalesce(items.n, 0)::bigint AS n_items,
    sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(SPACED, True)} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle
    FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
    ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, min(r)::bigint AS component_id, d.doc_id = min(r) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::bigint AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_words(SPACED, False)} AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS first FROM places) WHERE first < doc_id),
removed AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM gone)),
counts AS (SELECT doc_id, list(j) AS js FROM removed GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(len(js), 0)::bigint AS n_removed,
    sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
        ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(js, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id)
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: CRC-32 of each byte, and of a string by the bytes of its hexadecimal form.
CRC_TABLE = """
SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""


def _crc(string: str) -> str:
    hex_bytes = f"list_transform(range(1, 2 * octet_length(encode({string})), 2), lambda i: ('0x' || substr(hex(encode({string})), i, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {hex_bytes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


RESAMPLE = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, {_words(ALNUM, True)} AS w FROM documents),
b AS (SELECT {_words(ALNUM, True)} AS w FROM benchmark),
f AS (
    SELECT doc_id, feature, count(*) AS c FROM (
        SELECT doc_id, unnest(w) AS feature FROM d
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
    ) GROUP BY ALL
), g AS (
    SELECT feature, count(*) AS c FROM (
        SELECT unnest(w) AS feature FROM b
        UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
    ) GROUP BY ALL
), known AS (SELECT feature, {_crc("feature")} % 10000 AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM g), crc),
s AS (SELECT bucket, sum(c) AS n FROM f JOIN known USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS n FROM g JOIN known USING (feature) GROUP BY bucket),
gains AS (
    SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((SELECT sum(n) FROM s) + 10000)::double
        / ((s.n + 1)::double * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::double)))::bigint AS gain
    FROM s LEFT JOIN t USING (bucket)
), weighed AS (
    SELECT doc_id, sum(c)::bigint AS n_features, floor(sum(c * gain)::double / sum(c))::bigint AS weight
    FROM f JOIN known USING (feature) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('7:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint AS h
    FROM d LEFT JOIN weighed USING (doc_id)
), noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT noisy.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM noisy LEFT JOIN ranked USING (doc_id)
"""

COLLAPSE_RUNS = f"""
WITH crc AS ({CRC_TABLE}),
given AS (SELECT doc_id, {_words(SPACED, False)} AS w, {_crc("doc_id::varchar")} AS h FROM documents, crc),
planned AS (
    SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS parts FROM given
), d AS (
    SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(0, n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END) + 1]) END AS w
    FROM planned
), places AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i - x.i BETWEEN 1 AND x.n // 3),
stretches AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS stretch FROM same),
periodic AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM stretches GROUP BY doc_id, p, stretch HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM periodic GROUP BY ALL),
best AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
        first({{'start': start, 'length': length, 'period': period}} ORDER BY length::double / period DESC, start, period) AS b
    FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": MIX,
        "op2_decontaminate": DECONTAMINATE,
        "op3_near_copies": NEAR_COPIES,
        "op4_warc": WARC,
        "op7_repeats": REPEATS,
        "op9_top_k": TOP_K,
        "op11_resample": RESAMPLE,
        "op12_collapse_runs": COLLAPSE_RUNS,
    }
