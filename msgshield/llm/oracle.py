"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import collocations, fingerprint, minhash, mixing, secrets, variants

_WORDS = r"[^\x20\x09-\x0D]+"


def _mix_sql() -> str:
    cycle = ", ".join(map(str, mixing.WEIGHT_CYCLE))
    passes, taken = "", []
    for i in range(mixing.PASSES):
        source, room = ("units", "plan") if not i else (f"left{i - 1}", f"room{i}")
        passes += f""",
run{i} AS (SELECT u.*, r.room, sum(words) OVER (PARTITION BY u.skey ORDER BY h, doc_id NULLS FIRST, size
        ROWS UNBOUNDED PRECEDING) <= r.room AND r.room > 0 AS fits FROM {source} u JOIN {room} r USING (skey)),
room{i + 1} AS (SELECT r.skey, r.room - coalesce(x.used, 0) AS room FROM {room} r LEFT JOIN
        (SELECT skey, sum(words) AS used FROM run{i} WHERE fits GROUP BY 1) x USING (skey)),
left{i} AS (SELECT q.* EXCLUDE (room, fits) FROM run{i} q JOIN room{i + 1} n USING (skey)
        WHERE NOT q.fits AND q.words <= n.room)"""
        taken.append(f"SELECT doc_id, skey, size FROM run{i} WHERE fits")
    return f"""
WITH sizes AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
        coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size,
        ([{cycle}])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHT_CYCLE)} + 1] AS w
        FROM sizes GROUP BY skey, source),
ranked AS (SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total,
        row_number() OVER o AS k,
        coalesce(sum({mixing.MAX_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
        FROM src WINDOW o AS (ORDER BY source_size::DOUBLE / w, skey)),
level AS (SELECT min_by((total - held)::DOUBLE / free, k) AS lv FROM ranked WHERE cap >= (total - held)::DOUBLE / free * w),
plan AS (SELECT skey, source_size, target, whole, floor(target)::BIGINT - whole * source_size AS room FROM (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM (
        SELECT skey, source_size, CASE WHEN cap < lv * w THEN cap::DOUBLE ELSE lv * w END AS target FROM ranked, level))),
units AS (SELECT doc_id, skey, size, size * count(*) AS words,
        md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM sizes GROUP BY doc_id, skey, size){passes},
taken AS ({' UNION ALL '.join(taken)})
SELECT s.doc_id, s.size, p.source_size::BIGINT AS source_size, p.target,
       (s.size * (p.whole + (t.size IS NOT NULL)::BIGINT))::BIGINT AS taken,
       (p.whole + (t.size IS NOT NULL)::BIGINT)::BIGINT AS copies
FROM sizes s JOIN plan p USING (skey)
LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM s.doc_id AND t.skey = s.skey AND t.size = s.size"""


_URL_SQL = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""

def _sketch(words: str) -> str:
    """Sorted distinct retained hashes of a list of words, as a list of hex strings."""
    k, d = fingerprint.SHINGLE, fingerprint.DIGITS
    shingles = (f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) <= {k} THEN [array_to_string({words}, ' ')] ELSE "
                f"list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i:i + {k - 1}], ' ')) END")
    hashes = f"list_transform({shingles}, lambda s: md5(s))"
    kept = f"list_filter({hashes}, lambda h: h < '{fingerprint.RETAIN:x}')"
    least = f"CASE WHEN len({kept}) = 0 AND len({words}) > 0 THEN [list_min({hashes})] ELSE {kept} END"
    return f"list_sort(list_distinct(list_transform({least}, lambda h: h[1:{d}])))"


def _alike(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE "
            f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END")


_FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, (length(text) - length(text) // 2)::INT) || substr(next_text, 1, (length(text) // 2)::INT) AS edited FROM n),
w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS w0, regexp_extract_all(edited, '{_WORDS}') AS w1,
        regexp_extract_all(next_text, '{_WORDS}') AS w2 FROM e),
s AS (SELECT doc_id, text, edited, {_sketch('w0')} AS s0, {_sketch('w1')} AS s1, {_sketch('w2')} AS s2 FROM w)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
        array_to_string(s0, '') AS fingerprint, array_to_string(s1, '') AS edited_fingerprint,
        {_alike('s0', 's1')} AS near_edited, {_alike('s0', 's2')} AS near_next FROM s"""


def _secret_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS kind, '{r.name}' AS rule, unnest(range(1, len(m) + 1)) AS i,
        unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap, {r.least} AS least FROM (SELECT doc_id,
        regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g,
        regexp_split_to_array(text, '{p}') AS gaps FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex, string_agg(concat_ws(':', rule, (stop - length(m))::BIGINT, stop::BIGINT), ','
        ORDER BY stop - length(m), kind) AS spans FROM f WHERE length(g) >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _collocation_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase "
        f"FROM w WHERE len(w) >= {k}" for k in range(1, collocations.MAX_WORDS + 1))
    cut = "string_split(c.phrase, ' ')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
longer AS (SELECT lang, max(a) AS longest, inner_phrase FROM (SELECT lang, a,
        unnest([array_to_string({cut}[1:k - 1], ' '), array_to_string({cut}[2:k], ' ')]) AS inner_phrase FROM c) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer l ON l.lang = c.lang AND l.inner_phrase = c.phrase
        WHERE l.longest IS NULL OR 100 * l.longest < {collocations.SHARE} * c.a),
cuts AS (SELECT *, array_to_string({cut}[1:cut], ' ') AS head, array_to_string({cut}[cut + 1:k], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c),
scored AS (SELECT cuts.*, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
        FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang)
WHERE rank <= {collocations.TOP}"""


def _variant_sql() -> str:
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    code = "unicode(c)"
    return f"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS x, 0 AS i FROM range(256) r(b)
        UNION ALL SELECT b, {step}, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE i = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c:
        CASE WHEN {code} < 128 THEN [{code}] ELSE [{code} // 64 + 192, {code} % 64 + 128] END)) AS bs FROM each),
sums AS (SELECT doc_id, w, n, xor(list_reduce(bs, lambda x, b: xor(x // 256, t[(xor(x, b) % 256) + 1]), 4294967295::BIGINT),
        4294967295) AS h FROM (SELECT doc_id, w, n, list_transform(bs, lambda b: b::BIGINT) AS bs FROM bytes), tab),
cut AS (SELECT CASE WHEN h % {variants.DELETE_EVERY} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT)
        ELSE w END AS word, n FROM sums),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST}),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word FROM less a JOIN v b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM less a JOIN v b ON a.rest = b.word),
near AS (SELECT p.word, p.near, v.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN v ON v.word = p.near),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {variants.FORM_TIMES} * v.n THEN near END AS form,
        CASE WHEN m >= {variants.FORM_TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)"""


def _minhash_sql() -> str:
    k, s = minhash.SHINGLE, minhash.SIMILARITY
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {k} THEN [array_to_string(w, ' ')] ELSE
        list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {s} * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
        w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)"""


ORACLE = {
    "op11_collocations": _collocation_sql(),
    "op12_spelling_variants": _variant_sql(),
    "op13_minhash_dedup": _minhash_sql(),
    "op1_mix_sources": _mix_sql(),
    "op6_document_fingerprints": _FINGERPRINT_SQL,
    "op8_url_rules": _URL_SQL,
    "op9_secret_ledger": _secret_sql(),
}
