"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules, sharding
from .decontaminate import SPAN

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_CHAR32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31)::INTEGER + 1, 1)" for s in (15, 10, 5, 0))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') t FROM pages), d AS (SELECT page_id, t, sha1(t) hex, max(page_id) OVER (PARTITION BY t) last FROM p)
SELECT page_id, strlen(t)::BIGINT payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(hex, 5*i+1, 5))::BIGINT), lambda v: {_CHAR32}), '') payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END refers_to, NULL::VARCHAR AS "error" FROM d"""

_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} ws FROM benchmark),
iw AS (SELECT DISTINCT id, least(len(ws), {SPAN}) n, array_to_string(list_slice(ws, k, k + {SPAN - 1}), ' ') g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {SPAN - 1}, 1) + 1)) k FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () r, doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} ws FROM documents),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) k FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT r, k, n, id FROM (SELECT * FROM dw SEMI JOIN iw USING (n, g)) JOIN iw USING (n, g)),
w AS (SELECT r, count(DISTINCT pos) n_hit FROM (SELECT r, unnest(range(k, k + n)) pos FROM h) GROUP BY 1),
s AS (SELECT r, count(DISTINCT id) n_items, string_agg(DISTINCT id, ',' ORDER BY id) ids FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN w USING (r) LEFT JOIN s USING (r)"""

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+?)\.?(?::\d*)?(?:[/?#]|$)', 1)), '')"
URL_FILTERS = rf"""
WITH p AS (SELECT page_id, url, (DATE '2024-01-01' + (((coalesce(page_id, 0) % 366) + 366) % 366)::INTEGER) fetched, {_HOST} host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) path FROM pages),
hs AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::BIGINT h FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (SELECT 'abuse' list, 'block' action, host pattern, 'add' change, DATE '2024-01-01' + (h % 200)::INTEGER AS since FROM hs WHERE h % 4 = 0
 UNION ALL SELECT 'abuse', 'block', host, 'remove', DATE '2024-01-01' + (h % 200 + 100)::INTEGER FROM hs WHERE h % 4 = 0
 UNION ALL SELECT 'abuse', 'block', host, 'add', DATE '2024-01-01' + (h % 200 + 130)::INTEGER FROM hs WHERE h % 8 = 4
 UNION ALL SELECT 'trusted', 'allow', host, 'add', DATE '2024-01-01' + (h % 200 + 20)::INTEGER FROM hs WHERE h % 6 = 0
 UNION ALL SELECT 'paths', 'block', host || '/en/', 'add', DATE '2024-01-01' + (h % 200 + 10)::INTEGER FROM hs WHERE h % 3 = 1
 UNION ALL SELECT 'domains', 'block', 'example.org', 'add', DATE '2024-06-01'),
v AS (SELECT list, action, pattern, change, since AS valid_from, lead(since) OVER (PARTITION BY list, action, pattern ORDER BY since) valid_until FROM e),
m AS (SELECT p.page_id, p.url, p.fetched, v.pattern, v.list, v.action, row_number() OVER (PARTITION BY p.page_id, p.url, p.fetched ORDER BY length(v.pattern) DESC, v.action = 'allow' DESC, v.pattern DESC, v.list DESC, v.action DESC) rn
 FROM p JOIN v ON v.change = 'add' AND p.fetched >= v.valid_from AND (v.valid_until IS NULL OR p.fetched < v.valid_until)
 AND (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern) OR (contains(v.pattern, '/') AND starts_with(p.host || regexp_replace(p.path, '[^/]*$', ''), v.pattern))))
SELECT p.page_id, p.url, p.fetched, m.pattern matched, m.list matched_list, m.action decision, m.action IS DISTINCT FROM 'block' kept
FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.url = m.url AND p.fetched = m.fetched AND rn = 1"""


def _quality() -> str:
    strip, text = [], "t"
    for pattern in quality_rules._STRIPPED:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
        strip.append(text)
    lengths = ["length(t)", *(f"length({s})" for s in strip), "0"]
    chars = "[" + ", ".join(f"{a} - {b}" for a, b in zip(lengths, lengths[1:])) + "]"
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality_rules.COMMON_WORDS.items())
    n = quality_rules.N_COMMON
    share = lambda x: f"list_transform({x}, lambda v: v::DOUBLE / nullif(list_sum({x}), 0))"
    h = lambda x: f"(CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0.0::DOUBLE END)"

    def distance(p: str, q: str, k: int) -> str:
        terms = " + ".join(f"({h(f'(({p}[{i}] + {q}[{i}]) / 2)')} - ({h(f'{p}[{i}]')} + {h(f'{q}[{i}]')}) / 2)" for i in range(1, k + 1))
        return f"sqrt(greatest({terms}, 0.0))"

    sums = lambda x, k: "[" + ", ".join(f"sum({x}[{i}])" for i in range(1, k + 1)) + "]"
    return rf"""
WITH d0 AS (SELECT row_number() OVER () r, doc_id, lang, coalesce(text, '') t FROM documents),
d1 AS (SELECT *, {_WORDS.format('t')} ws, {chars} ch, CASE lang {lists} END cw FROM d0),
d2 AS (SELECT *, len(ws)::BIGINT n_words, list_transform(cw, lambda c: len(list_filter(ws, lambda w: w = c))) cc FROM d1),
d AS (SELECT *, list_append(cc, n_words - list_sum(cc)) common FROM d2),
refs AS (SELECT lang, {sums('ch', 7)} rc, {sums('common', n + 1)} rw FROM d WHERE cw IS NOT NULL GROUP BY 1),
rs AS (SELECT lang, {share('rc')} rc, {share('rw')} rw FROM refs),
tri AS (SELECT r, k, ws[k] || ' ' || ws[k+1] || ' ' || ws[k+2] g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) k FROM d WHERE len(ws) >= 3)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) c FROM tri) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT pos) n_repeat FROM (SELECT r, unnest([k, k+1, k+2]) pos FROM twice) GROUP BY 1),
f AS (SELECT d.r, doc_id, d.lang, n_words, length(t) - ch[2] word_chars, ch[6] n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ln, coalesce(n_repeat, 0)::BIGINT n_repeat_words, length(t) n_all, {share('ch')} pc, {share('common')} pw FROM d LEFT JOIN rep USING (r)),
b AS (SELECT f.*, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words base_failed,
 CASE WHEN rs.lang IS NOT NULL AND n_all >= {quality_rules.MIN_CHARS_JUDGED} THEN {distance('pc', 'rc', 7)} END cd,
 CASE WHEN rs.lang IS NOT NULL AND n_words >= {quality_rules.MIN_WORDS_JUDGED} THEN {distance('pw', 'rw', n + 1)} END wd,
 {distance('[' + '0.0::DOUBLE, ' * n + '1.0::DOUBLE]', 'rw', n + 1)} most FROM f LEFT JOIN rs USING (lang))
SELECT doc_id, n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce(cd > {quality_rules.MAX_CHAR_DISTANCE} OR wd > {quality_rules.MAX_WORD_SHARE} * most, false) kept FROM b"""


def _mixing() -> str:
    source, block = "coalesce('=' || source, '')", f"substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 3)"
    share = "tok / (SELECT sum(tok) FROM t)::DOUBLE"
    of = "(SELECT {what} FROM (SELECT " + share + " p, pow(tok / (SELECT max(tok) FROM t)::DOUBLE, {a}) x FROM t))"
    even = of.replace("{what}", f"ln(sum(x)) - sum(CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END) / sum(x) <= {mixing.TARGET_ENTROPY} * ln(count(*))")
    few = of.replace("{what}", f"coalesce(max(x / p) / nullif(min(x / p), 0) <= {mixing.MAX_EPOCHS}, false)")
    steps, last = [f"b0 AS MATERIALIZED (SELECT CASE WHEN {even.format(a='1.0')} THEN 0.0 ELSE 1.0 END::DOUBLE lo, CASE WHEN {even.format(a='1.0')} THEN 1.0 ELSE {mixing.MOST_ALPHA} END::DOUBLE hi, {even.format(a='1.0')} AS under)"], "b0"
    for k in range(1, mixing.STEPS + 1):
        middle = f"(SELECT (lo + hi) / 2 FROM {last})"
        ok = f"(SELECT CASE WHEN under THEN {even.format(a=middle)} AND {few.format(a=middle)} ELSE {even.format(a=middle)} OR NOT {few.format(a=middle)} END FROM {last})"
        steps.append(f"b{k} AS MATERIALIZED (SELECT CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END lo, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END hi, under FROM {last}, (SELECT {ok} ok))")
        last = f"b{k}"
    return rf"""
WITH k AS MATERIALIZED (SELECT {source} src, {block} blk, sum(len({_WORDS.format("coalesce(text, '')")}))::BIGINT tok FROM documents GROUP BY 1, 2),
s AS MATERIALIZED (SELECT src, sum(tok)::BIGINT tok FROM k GROUP BY 1), t AS MATERIALIZED (SELECT * FROM s WHERE tok > 0), {', '.join(steps)},
al AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM t) <= 1 THEN 1.0 WHEN under AND {even.format(a='0.0')} AND {few.format(a='0.0')} THEN 0.0
 WHEN NOT under AND NOT {even.format(a=f'{mixing.MOST_ALPHA}')} AND {few.format(a=f'{mixing.MOST_ALPHA}')} THEN 1.0 WHEN under OR {few.format(a=f'(SELECT hi FROM {last})')} THEN hi ELSE lo END a FROM {last}),
x AS MATERIALIZED (SELECT src, tok, {share} p, pow(tok / (SELECT max(tok) FROM t)::DOUBLE, a) x FROM t, al),
e AS (SELECT s.src, s.tok, coalesce(round(x / p / (SELECT min(x / p) FROM x), 6), 1.0) ep FROM s LEFT JOIN x USING (src)),
pl AS MATERIALIZED (SELECT src, floor(ep)::BIGINT passes, (ep - floor(ep)) * tok rest FROM e),
o AS (SELECT k.src, tok, rest, md5('{mixing.SEED}:' || passes::VARCHAR || ':' || k.src || ':' || blk) ord FROM k JOIN pl USING (src)),
r AS (SELECT src, ord, rest, sum(tok) OVER (PARTITION BY src ORDER BY ord ROWS UNBOUNDED PRECEDING) reach FROM o),
la AS (SELECT src, max(ord) last FROM r WHERE reach <= rest GROUP BY 1),
c AS (SELECT doc_id, source, d.src, blk, passes, last, unnest(range(0, passes + 1)) epoch FROM (SELECT doc_id, source, {source} src, {block} blk FROM documents) d JOIN pl USING (src) LEFT JOIN la USING (src)),
q AS (SELECT *, md5('{mixing.SEED}:' || epoch::VARCHAR || ':' || src || ':' || blk) position FROM c)
SELECT doc_id, source, epoch::BIGINT epoch, position FROM q WHERE epoch < passes OR position <= last"""


SHARDING = f"""SELECT doc_id, source, strlen(text)::BIGINT n_bytes, md5(text) text_md5, (('0x' || substr(md5('arrival:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INTEGER % {sharding.ARRIVALS})::INTEGER arrival,
 {sharding.ARRIVALS + 1}::BIGINT "version", true merged FROM documents"""

TRIE = r"""
WITH t AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) k, {'r': coalesce(role, ''), 'x': coalesce(text, '')} s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(s ORDER BY k) s FROM t GROUP BY 1),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 h FROM o),
b AS (SELECT h.c, list_concat(coalesce(list_slice(o.s, 1, h.h), []), list_slice(h.s, h.h + 1, len(h.s))) s FROM h LEFT JOIN o ON o.c = h.c - h.c % 20),
m AS (SELECT c, d, list_slice(s, 1, d) p, len(s) = d AS done FROM (SELECT c, s, unnest(range(0, len(s) + 1)) d FROM b)),
n AS (SELECT p, d, min(c) c, count(*) n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (done), '') ends FROM m GROUP BY 1, 2),
k AS (SELECT list_slice(p, 1, d - 1) p, count(*) kids FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(kids, 0) kids, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(p[d].x, '[\x20\x09-\x0D]+'), lambda v: v <> '')) END saved FROM n LEFT JOIN k USING (p)),
a AS (SELECT list_slice(p, 1, e) p, sum((kids = 0)::INTEGER) n_leaves, sum(saved) saved FROM (SELECT *, unnest(range(0, d + 1)) e FROM w) GROUP BY 1)
SELECT w.c conv_id, w.d depth, u.c parent_conv_id, w.n_convs, w.kids n_children, a.n_leaves::BIGINT n_leaves, a.saved::BIGINT saved_tokens, sha256(w.ends) ends_sha256
FROM w JOIN a USING (p) LEFT JOIN n u ON w.d > 0 AND u.d = w.d - 1 AND u.p = list_slice(w.p, 1, w.d - 1)"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r ar, b.r br, a.vec_id anchor_id, b.vec_id, a.l = b.l same, list_inner_product(a.e, b.e)::BIGINT score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT ar, br, anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, vec_id))::INTEGER "rank", vec_id negative_id, positive_score, score negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY "rank" <= 3"""

# in blocks of 1,000 bytes, for a substring far into a text is slow to reach
REPEATS = """
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(doc_id, 9223372036854775807) o, hex(encode(coalesce(text, ''))) x FROM documents),
b AS (SELECT r, o, j, substr(x, (2000 * j + 1)::BIGINT, 2198) y FROM (SELECT *, unnest(range(0, (length(x) + 1801) // 2000)) j FROM d)),
w AS (SELECT r, o, 1000 * j + q p, substr(y, (2 * q + 1)::BIGINT, 200) g FROM (SELECT *, unnest(range(0, length(y) // 2 - 99)) q FROM b)),
f AS (SELECT r, p FROM w JOIN (SELECT g, min((o, p)) first FROM w GROUP BY 1) USING (g) WHERE (o, p) > first),
s AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END new FROM f)),
i AS (SELECT r, min(p) lo, max(p) + 100 hi FROM s GROUP BY r, run),
k AS (SELECT r, sum(hi - lo)::BIGINT gone, count(*) spans, list(lo ORDER BY lo) lo, list(hi ORDER BY lo) hi FROM i GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT n_bytes, coalesce(gone, 0) n_removed, coalesce(spans, 0) n_spans,
 sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE array_to_string(list_transform(range(0, spans + 1), lambda j: substr(x, (CASE WHEN j = 0 THEN 1 ELSE 2 * hi[j] + 1 END)::BIGINT,
  (CASE WHEN j = spans THEN length(x) ELSE 2 * lo[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE 2 * hi[j] END)::BIGINT)), '') END)) kept_sha256
FROM d LEFT JOIN k USING (r)"""

#: op2, op4, op7 and op8 have no SQL form; tests/llm holds them against brute force, round trips and held-out rows.
SQL = {
    "op1_warc": WARC,
    "op3_decontamination": DECONTAMINATION,
    "op5_url_filters": URL_FILTERS,
    "op6_quality_rules": _quality(),
    "op9_sharding": SHARDING,
    "op10_mixing": _mixing(),
    "op11_prefix_trie": TRIE,
    "op12_negatives": NEGATIVES,
    "op13_repeats": REPEATS,
}
