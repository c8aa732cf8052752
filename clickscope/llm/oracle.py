"""DuckDB SQL of the queries that SQL can express.

The others (BPE, HTML, SimHash components, learned models, a minimax search, MinHash)
are held against brute force in ``tests/llm/``.
"""

_BARE = r"regexp_replace({}, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
pages AS (SELECT DISTINCT source, coalesce(text, '') AS t FROM documents),
tot AS (SELECT source, count(*) AS n FROM pages GROUP BY 1),
page_lines AS (SELECT DISTINCT source, t, {_BARE.format("line")} AS bare
  FROM (SELECT source, t, unnest(string_split(t, chr(10))) AS line FROM pages)),
bad AS (SELECT p.source, bare FROM page_lines p JOIN tot ON p.source IS NOT DISTINCT FROM tot.source
  WHERE bare <> '' GROUP BY p.source, bare, n HAVING count(*) > 0.05 * n AND count(*) >= 3),
lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines l
  LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND {_BARE.format("line")} = bad.bare
  WHERE bad.bare IS NULL GROUP BY l.rid),
both_texts AS (SELECT doc_id, d.text AS a, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS b FROM d LEFT JOIN kept USING (rid))
SELECT doc_id, len(string_split(coalesce(a, ''), chr(10)))::BIGINT AS n_lines,
  (CASE WHEN a IS NOT DISTINCT FROM b THEN 0
    ELSE len(string_split(a, chr(10))) - CASE WHEN b = '' THEN 0 ELSE len(string_split(b, chr(10))) END END)::BIGINT AS n_dropped,
  sha256(coalesce(b, '')) AS text_sha256
FROM both_texts
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x{{00}}-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM grams),
windows AS (SELECT rid, i, n, w[i:i + n - 1] AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM windows JOIN grams USING (g)),
words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(n)) AS k FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_RULES = (("word_length", "word_chars", "n_words", 16, 1, True), ("symbols", "n_symbols", "n_words", 32, 1, False),
          ("dup_lines", "n_dup_lines", "n_lines", 2, 1, False), ("repeats", "n_repeat_words", "n_words", 10, 6, False))
_MEASURED = [(name, f"CASE WHEN {under} > 0 THEN (1000 * {over}) // {under} ELSE 0 END") for name, over, under, *_ in _RULES]
_VALUES = " UNION ALL ".join(f"SELECT rid, lang, source, '{name}' AS rule, {v} AS v FROM counted WHERE NOT base_failed"
                             for name, v in [*_MEASURED, ("n_words", "n_words"), ("n_lines", "n_lines")])
_RULE_ROWS = ", ".join(f"('{name}', '{under}', {spread}, {unit}, {low})" for name, _, under, spread, unit, low in _RULES)
_BLEND = lambda own, wider: ", ".join(f"({own}.size * {own}.q{k} + 100 * {wider}.q{k}) // ({own}.size + 100) AS q{k}" for k in (1, 2, 3))


def _quartiles(by: str) -> str:
    at = ", ".join(f"min(CASE WHEN upto * 4 >= size * {q} THEN bin END) AS q{q}" for q in (1, 2, 3))
    return (f"SELECT {by}, max(size) AS size, {at} FROM (SELECT {by}, bin, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bin) AS upto, "
            f"sum(count(*)) OVER (PARTITION BY {by}) AS size FROM binned GROUP BY {by}, bin) GROUP BY {by}")


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
spots AS (SELECT rid, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM spots) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM d JOIN w USING (rid) LEFT JOIN reps USING (rid) LEFT JOIN lines USING (rid)),
vals AS ({_VALUES}),
binned AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bin FROM vals),
own AS ({_quartiles("lang, source, rule")}), by_lang AS ({_quartiles("lang, rule")}), whole AS ({_quartiles("rule")}),
lang_q AS (SELECT l.lang, l.rule, {_BLEND("l", "a")} FROM by_lang l JOIN whole a ON l.rule = a.rule),
own_q AS (SELECT o.lang, o.source, o.rule, {_BLEND("o", "l")} FROM own o JOIN lang_q l ON o.rule = l.rule AND o.lang IS NOT DISTINCT FROM l.lang),
rules(rule, under, spread, unit, low) AS (VALUES {_RULE_ROWS}),
steps AS (SELECT o.*, spread, low, 1000 * unit // greatest(u.q1, 1) AS step FROM own_q o JOIN rules r ON o.rule = r.rule
  JOIN own_q u ON u.rule = r.under AND o.lang IS NOT DISTINCT FROM u.lang AND o.source IS NOT DISTINCT FROM u.source),
verdict AS (SELECT v.rid, bool_and(v.v <= q3 + spread * greatest(q3 - q2, step) AND (NOT low OR v.v >= q1 - spread * greatest(q2 - q1, step))) AS fits
  FROM vals v JOIN steps s ON v.rule = s.rule AND v.lang IS NOT DISTINCT FROM s.lang AND v.source IS NOT DISTINCT FROM s.source GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, false) AS kept
FROM counted LEFT JOIN verdict USING (rid)
"""

_FRAMED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FRAME_OF = lambda text: " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", text))
_LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by its table of 256 remainders, made by eight shifts each.
_CRC_TABLE = ("SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
              "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t")
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)")


def _forest(name: str, key: str, levels: int) -> str:
    """Levels ``name_0`` (given; ``key, pos, n, h``) to ``name_<levels>`` with the siblings of each node."""
    parts = []
    for k in range(levels):
        run = f"(PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN "
        parts.append(f"""{name}_s{k} AS (SELECT *, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}_{k})""")
        parts.append(f"""{name}_{k + 1} AS (SELECT {key}, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {name}_{k} GROUP BY {key}, pos // 8, n)""")
    return ",\n".join(parts)


def _climb(name: str, key: str, levels: int, walk: str) -> str:
    """``walk_0`` (``key, pos, f, proof`` and more) folded up a forest."""
    return ",\n".join(f"""{walk}_{k + 1} AS (SELECT w.* REPLACE (w.pos // 8 AS pos, CASE WHEN s.n = 1 THEN w.f ELSE sha256(s.lft || w.f || s.rgt) END AS f, w.proof || s.lft || s.rgt AS proof)
  FROM {walk}_{k} w JOIN {name}_s{k} s ON s.{key} IS NOT DISTINCT FROM w.{key} AND s.pos = w.pos)""" for k in range(levels))


_LANG_LEVELS, _TOP_LEVELS = 8, 3  # 16 million documents a language, 512 languages

MERKLE = f"""
WITH crc AS ({_CRC_TABLE}),
leaves AS (SELECT doc_id, lang, sha256({_FRAME_OF("text")}) AS h,
    sha256({_FRAME_OF(f"(CASE WHEN {_CRC} % 3 = 0 THEN {_LOWER_TEXT} ELSE text END)")}) AS other FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
t_0 AS (SELECT lang, pos, n, h FROM placed),
{_forest("t", "lang", _LANG_LEVELS)},
u_0 AS (SELECT 0 AS g, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM t_{_LANG_LEVELS}),
{_forest("u", "g", _TOP_LEVELS)},
w_0 AS (SELECT doc_id, lang, h AS leaf, pos, other AS f, '' AS proof FROM placed),
{_climb("t", "lang", _LANG_LEVELS, "w")},
v_0 AS (SELECT w.* REPLACE (u.pos AS pos), 0 AS g, u.h AS subroot FROM w_{_LANG_LEVELS} w JOIN u_0 u ON u.lang IS NOT DISTINCT FROM w.lang),
{_climb("u", "g", _TOP_LEVELS, "v")}
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u.h AS verified FROM v_{_TOP_LEVELS} v, u_{_TOP_LEVELS} u
"""

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 5) r(k)) GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1),
inner_parts AS (SELECT DISTINCT lang, q, a, p FROM (SELECT lang, p, a, unnest(list_transform(range(1, len(p) - k + 2), lambda i: p[i:i + k - 1])) AS q
  FROM cand, range(2, 4) r(k) WHERE len(p) > k)),
absorbed AS (SELECT lang, q, max(a) AS most FROM inner_parts GROUP BY lang, q),
kept AS (SELECT c.* FROM cand c LEFT JOIN absorbed b ON b.lang = c.lang AND b.q = c.p WHERE b.most IS NULL OR 100 * b.most < 80 * c.a),
cuts AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept) c
  JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN grams y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT b.*, array_to_string(p, ' ') AS phrase FROM best b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op2_line_dedup": LINE_DEDUP, "op5_decontamination": DECONTAMINATION, "op7_quality": QUALITY,
                       "op12_merkle_manifest": MERKLE, "op13_collocations": COLLOCATIONS}
