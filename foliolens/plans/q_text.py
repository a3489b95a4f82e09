"""Queries over texts and raw HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import skew
from ..functions import sql as fsql
from ..functions import text as tx
from ..functions.common import PAGE_KEY
from ..operators import html as ht
from ..operators import text as ot
from .q_layout import _split
from .registry import query
from .sqltext import pr
from .views import VIEW_SQL, _BUILDERS, kana, load, text_rows, view

NL = "chr(10)"


def chain(column: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


# corpus texts with the Japanese phrases the cleanup rules look for
PHRASES = [(". e", "できます。必要なら、e"), (". l", "です。これは単なるl"), (", l", "ではなくl"), (". de ", "。aiだけでは判断できません。確認済みはaiで未確認。de "),
           (". p", "です。必要であれば p"), (". q", "。qの方 というよりq")]
JTEXT = chain("lower(text)", PHRASES)
VIEW_SQL["v_jdocs"] = f"SELECT doc_id, lang, source, {JTEXT} AS text FROM documents"
_BUILDERS["v_jdocs"] = lambda s, d: text_rows(s, d, "documents", "doc_id").selectExpr("doc_id", "lang", "source", f"{JTEXT} AS text")

# corpus texts with Markdown structure
MARKS = [(chr(10) + "E", "\n```\nE"), ("\nL", "\n~~~~ x\nL"), ("\nA", "\n> A"), ("\nD", "\n| D |\nD"), ("\nT", "\n- T"), ("\nS", "\n````\nS"), ("\nU", "\n   ~~~~~  \nU"), ("\nW", "\n## W"), ("\nO", "\nMEDIA: O"),
         (" la ", " `la` "), (" de ", " [de](x) "), (" le ", " http://le/ "), (" un ", " /un/y "), (" the ", " ![t](u) "), (" of ", " MEDIA:of ")]
MTEXT = "text"
for _old, _new in MARKS:
    MTEXT = f"replace({MTEXT}, '{_old}', '{_new}')"
VIEW_SQL["v_mdocs"] = f"SELECT doc_id, {MTEXT} AS text FROM documents"
_BUILDERS["v_mdocs"] = lambda s, d: text_rows(s, d, "documents", "doc_id").selectExpr("doc_id", f"{MTEXT.replace(chr(10), chr(92) + 'n')} AS text")


def lines_sql(src: str) -> str:
    """Lines with their ends; texts hold no other line end than a newline."""
    return (f"SELECT doc_id, CAST(i AS INT) AS line_no, CASE WHEN i + 1 < len(parts) THEN concat(parts[i + 1], {NL}) ELSE parts[i + 1] END AS line "
            f"FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM {src}), unnest(range(len(parts))) AS u(i) WHERE NOT (i + 1 = len(parts) AND parts[i + 1] = '' AND len(parts) > 1)")


VIEW_SQL["v_jlines"] = lines_sql("v_jdocs")
VIEW_SQL["v_mlines"] = lines_sql("v_mdocs")


@query("t1_to_lines", lines_sql("documents"))
def t1(spark, d):
    return ot.to_lines(load(spark, d, "documents"))


VIEW_SQL["v_marks"] = r"""SELECT doc_id, line_no, regexp_extract(line, '^\s*(`{3,}|~{3,})', 1) AS m, trim(regexp_replace(line, '^\s*(`{3,}|~{3,})', ''), ' ' || chr(10)) = '' AS bare,
  row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM v_mlines WHERE regexp_matches(line, '^\s*(`{3,}|~{3,})')"""
SPANS = """w AS (SELECT doc_id, k, line_no, m, CAST(NULL AS INT) AS lo, CAST(NULL AS INT) AS hi, line_no AS open_at, m AS open_m FROM v_marks WHERE k = 1
 UNION ALL SELECT n.doc_id, n.k, n.line_no, n.m, CASE WHEN w.open_at IS NOT NULL AND substr(n.m,1,1) = substr(w.open_m,1,1) AND length(n.m) >= length(w.open_m) AND n.bare THEN w.open_at END,
   CASE WHEN w.open_at IS NOT NULL AND substr(n.m,1,1) = substr(w.open_m,1,1) AND length(n.m) >= length(w.open_m) AND n.bare THEN n.line_no END,
   CASE WHEN w.open_at IS NULL THEN n.line_no WHEN substr(n.m,1,1) = substr(w.open_m,1,1) AND length(n.m) >= length(w.open_m) AND n.bare THEN NULL ELSE w.open_at END,
   CASE WHEN w.open_at IS NULL THEN n.m ELSE w.open_m END FROM w JOIN v_marks n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
sp AS (SELECT doc_id, lo, hi FROM w WHERE lo IS NOT NULL UNION ALL SELECT doc_id, open_at, 1000000000 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM w) WHERE r = 1 AND open_at IS NOT NULL),
fl AS (SELECT l.doc_id, l.line_no, l.line, EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = l.doc_id AND l.line_no BETWEEN lo AND hi) AS fenced FROM v_mlines l)"""


@query("t2_mark_fences", f"WITH RECURSIVE {SPANS} SELECT doc_id, line_no, line, fenced FROM fl")
def t2(spark, d):
    return ot.mark_fences(view(spark, d, "v_mdocs"))


KIND = r"CASE WHEN regexp_matches(line, '^\s*>') THEN 'blockquote' WHEN regexp_matches(line, '^\s*\|[^\n]*\|\s*$') THEN 'pipe_table' WHEN regexp_matches(line, '^\s*MEDIA:') THEN 'media' ELSE 'normal' END"


@query("t3_classify_lines", f"SELECT doc_id, line_no, {KIND} AS kind FROM v_mlines")
def t3(spark, d):
    return ot.classify_lines(ot.to_lines(view(spark, d, "v_mdocs"))).select("doc_id", "line_no", "kind")


PREFIX_RE = r"^(\s*(?:#{1,6}\s+|(?:[-*+] |\d+[.)] )))"
INLINE_RE = r"(`[^`]*`|!?\[[^\]]*\]\([^)]*\)|https?://[^\s<>()]+|MEDIA:\S*)|(^|\s)(/[\w.~:-]+(?:/[\w.~:-]+)*)"


@query("t4_split_inline_segments", f"""
WITH RECURSIVE {SPANS},
x AS (SELECT *, fenced OR {KIND} <> 'normal' AS whole, regexp_extract(line, '{PREFIX_RE}', 1) AS pre FROM fl),
y AS (SELECT *, regexp_replace(substr(line, length(pre) + 1), '{INLINE_RE}', concat('\\2', chr(64976), '\\1\\3', chr(64977)), 'g') AS mk FROM x WHERE NOT whole),
z AS (SELECT doc_id, line_no, line, pre, list_filter(string_split(replace(replace(mk, chr(64976), concat(chr(64978), chr(64976))), chr(64977), concat(chr(64977), chr(64978))), chr(64978)), lambda q: q <> '') AS ps FROM y),
p AS (SELECT doc_id, line_no, 0 AS k, true AS protected, line AS text FROM x WHERE whole UNION ALL SELECT doc_id, line_no, 0, true, pre FROM z WHERE pre <> ''
 UNION ALL SELECT doc_id, line_no, CAST(i + 1 AS INT), starts_with(ps[i + 1], chr(64976)), replace(replace(ps[i + 1], chr(64976), ''), chr(64977), '') FROM z, unnest(range(len(ps))) AS u(i)
 UNION ALL SELECT doc_id, line_no, 0, false, line FROM z WHERE pre = '' AND len(ps) = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS INT) AS seg_no, line_no, protected, text FROM p""")
def t4(spark, d):
    return ot.split_segments(view(spark, d, "v_mdocs"))


SENT_RE = "[^。．!?！？]+[。．!?！？]?"
VIEW_SQL["v_jsents"] = (f"SELECT doc_id, line_no AS seg_no, CAST(i AS INT) AS sent_no, ss[i + 1] AS sentence FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{SENT_RE}') AS ss, line FROM v_jlines), "
                        "unnest(range(len(ss))) AS u(i) WHERE array_to_string(ss, '') = line")


@query("t5_split_sentences", "SELECT doc_id, seg_no, sent_no, sentence FROM v_jsents")
def t5(spark, d):
    return ot.sentences(ot.split_segments(view(spark, d, "v_jdocs"))).select("doc_id", "seg_no", "sent_no", "sentence")


PROT = r"regexp_matches(sentence, '[0-9]|https?://|(^|\s)/[\w./~:-]+|MEDIA:|`[^`]+`|\b[A-Z][A-Za-z0-9_-]*\b')"
UNSAFE = "regexp_matches(sentence, '(?i)承認|許可|権限|認可|停止|安全|再起動|restart|gateway|送信|Slack|Discord|外部|費用|課金|支払|payment|cost|時刻|時間|手順|依存|authorization|approval')"
OFFER = r"regexp_replace(sentence, '^(必要なら|必要であれば)[、,\s]*', '')"
RIGHT = "(?:です|ます|でした|ました)"
CH = f"^これは単なる([^。．!?！？\\n]{{1,80}})ではなく[、,\\s]*([^。．!?！？\\n]{{1,120}}{RIGHT})[。．]?$"
CR = f"^([^。．!?！？\\n]{{1,80}})というより[、,\\s]*([^。．!?！？\\n]{{1,120}}{RIGHT})[。．]?$"
PNOUN = "(?:株式会社|有限会社|合同会社|[都道府県]$|[市区町村]$|大学|病院|銀行)"


def half(re_: str) -> str:
    l, r = f"trim(regexp_extract(sentence, '{re_}', 1))", f"trim(regexp_extract(sentence, '{re_}', 2))"
    return (f"CASE WHEN {l} <> '' AND {r} <> '' AND NOT regexp_matches({l}, '{PNOUN}') AND NOT regexp_matches({r}, '{PNOUN}') THEN concat({r}, CASE WHEN right(sentence, 1) IN ('。', '．') THEN right(sentence, 1) ELSE '' END) END")


UNC = "^(.+?)(?:だけでは|のみでは)(?:結論|判断|断定)(?:でき|し)ません[。．]?$"
VIEW_SQL["v_judged"] = f"""
SELECT doc_id, seg_no, sent_no, sentence, coalesce(offer, ct, CASE WHEN gone THEN '' END) AS result,
  CASE WHEN offer IS NOT NULL THEN CASE WHEN contains(sentence, '必要なら') THEN 'F1' ELSE 'F2' END WHEN ct IS NOT NULL THEN cr WHEN gone THEN 'E1' END AS rule FROM (
 SELECT *, CASE WHEN regexp_matches(sentence, '^(必要なら|必要であれば)') AND NOT prot AND NOT {UNSAFE} AND regexp_matches({OFFER}, '(?:できます|可能です|選択肢は.+です)[。．]?$') THEN {OFFER} END AS offer,
  CASE WHEN NOT prot THEN CASE WHEN regexp_matches(sentence, '{CH}') THEN {half(CH)} WHEN regexp_matches(sentence, '{CR}') THEN {half(CR)} END END AS ct, CASE WHEN regexp_matches(sentence, '{CH}') THEN 'C1' ELSE 'C2' END AS cr,
  regexp_matches(trim(sentence, ' ' || chr(10)), '{UNC}') AND NOT prot AND contains(ctx, trim(regexp_extract(trim(sentence, ' ' || chr(10)), '{UNC}', 1))) AND regexp_matches(ctx, '(?:確認済み|確認できた|確認した)(?:は|.{{0,60}}(?:は|:|：))')
   AND regexp_matches(ctx, '(?:未確認|不明|未解決|確認できていない)') AS gone
 FROM (SELECT *, {PROT} AS prot, concat(lag(sentence, 2, '') OVER w, lag(sentence, 1, '') OVER w, lead(sentence, 1, '') OVER w, lead(sentence, 2, '') OVER w) AS ctx FROM v_jsents WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY sent_no)))"""


@query("t6_protected_sentence", f"SELECT doc_id, seg_no, sent_no, {PROT} AS protected FROM v_jsents")
def t6(spark, d):
    return ot.sentences(ot.split_segments(view(spark, d, "v_jdocs"))).select("doc_id", "seg_no", "sent_no", tx.is_protected(F.col("sentence")).alias("protected"))


def _judged(spark, d):
    return ot.judge_sentences(ot.split_segments(view(spark, d, "v_jdocs")))


@query("t7_rule_offer", "SELECT doc_id, seg_no, sent_no, result, rule FROM v_judged WHERE rule IN ('F1', 'F2')")
def t7(spark, d):
    return _judged(spark, d).where("rule IN ('F1', 'F2')").drop("sentence")


@query("t8_rule_contrast", "SELECT doc_id, seg_no, sent_no, result, rule FROM v_judged WHERE rule IN ('C1', 'C2')")
def t8(spark, d):
    return _judged(spark, d).where("rule IN ('C1', 'C2')").drop("sentence")


@query("t9_rule_redundant", "SELECT doc_id, seg_no, sent_no, result, rule FROM v_judged WHERE rule = 'E1'")
def t9(spark, d):
    return _judged(spark, d).where("rule = 'E1'").drop("sentence")


VIEW_SQL["v_rewritten"] = """
SELECT l.doc_id, line_no AS seg_no, CASE WHEN n BETWEEN 1 AND 2 THEN t ELSE line END AS text, CASE WHEN n BETWEEN 1 AND 2 THEN rules ELSE '' END AS rules, CAST(least(coalesce(n, 0), 3) AS INT) AS candidates FROM v_jlines l LEFT JOIN (
 SELECT doc_id, seg_no, count(rule) AS n, string_agg(coalesce(result, sentence), '' ORDER BY sent_no) AS t, coalesce(string_agg(rule, ',' ORDER BY sent_no), '') AS rules FROM v_judged GROUP BY 1, 2) j ON j.doc_id = l.doc_id AND j.seg_no = l.line_no"""


@query("t10_apply_rewrites", "SELECT doc_id, seg_no, text, rules, candidates FROM v_rewritten")
def t10(spark, d):
    out = ot.apply_rewrites(ot.split_segments(view(spark, d, "v_jdocs")))
    return out.withColumn("rules", F.array_join("rules", ","))


CAPPED = """cs AS (SELECT doc_id, seg_no, candidates AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS k FROM v_rewritten WHERE candidates > 0),
cw AS (SELECT doc_id, seg_no, k, CASE WHEN n <= 2 THEN n ELSE 0 END AS used, n <= 2 AS ok FROM cs WHERE k = 1
 UNION ALL SELECT c.doc_id, c.seg_no, c.k, CASE WHEN c.n <= 2 AND w.used + c.n <= 8 THEN w.used + c.n ELSE w.used END, c.n <= 2 AND w.used + c.n <= 8 FROM cw w JOIN cs c ON c.doc_id = w.doc_id AND c.k = w.k + 1),
dt AS (SELECT l.doc_id, string_agg(CASE WHEN cw.ok THEN r.text ELSE l.line END, '' ORDER BY l.line_no) AS text, coalesce(string_agg(CASE WHEN cw.ok THEN r.rules END, ',' ORDER BY l.line_no), '') AS rules
  FROM v_jlines l JOIN v_rewritten r ON r.doc_id = l.doc_id AND r.seg_no = l.line_no LEFT JOIN cw ON cw.doc_id = l.doc_id AND cw.seg_no = l.line_no GROUP BY 1)"""


@query("t11_cap_document", f"WITH RECURSIVE {CAPPED} SELECT doc_id, text, rules FROM dt")
def t11(spark, d):
    return ot.rewrite_documents(view(spark, d, "v_jdocs")).select("doc_id", "text", F.array_join("rules", ",").alias("rules"))


@query("t11_cap_response", """
WITH tot AS (SELECT doc_id, sum(candidates) AS n FROM v_rewritten GROUP BY 1)
SELECT l.doc_id, string_agg(CASE WHEN n BETWEEN 1 AND 2 THEN r.text ELSE l.line END, '' ORDER BY l.line_no) AS text, coalesce(string_agg(CASE WHEN n BETWEEN 1 AND 2 THEN nullif(r.rules, '') END, ',' ORDER BY l.line_no), '') AS rules
FROM v_jlines l JOIN v_rewritten r ON r.doc_id = l.doc_id AND r.seg_no = l.line_no JOIN tot ON tot.doc_id = l.doc_id GROUP BY 1""")
def t11_response(spark, d):
    return ot.rewrite_documents(view(spark, d, "v_jdocs"), "response").select("doc_id", "text", F.array_join("rules", ",").alias("rules"))


@query("t12_rewrite_report", f"""
WITH RECURSIVE {CAPPED} SELECT dt.doc_id, dt.text <> j.text AS changed, CAST(CASE WHEN dt.rules = '' THEN 0 ELSE len(string_split(dt.rules, ',')) END AS INT) AS rewrite_count, dt.rules, j.text = '' AS protected FROM dt JOIN v_jdocs j USING (doc_id)""")
def t12(spark, d):
    return ot.rewrite_report(view(spark, d, "v_jdocs")).select("doc_id", "changed", "rewrite_count", F.array_join("rules", ",").alias("rules"), "protected")


@query("t13_rewrite_rule_stats", f"""
WITH RECURSIVE {CAPPED}, x AS (SELECT lang, unnest(string_split(rules, ',')) AS rule FROM dt JOIN v_jdocs USING (doc_id) WHERE rules <> '')
SELECT lang, rule, count(*) AS hits, CAST(grouping(lang, rule) AS BIGINT) AS level FROM x GROUP BY ROLLUP (lang, rule)""")
def t13(spark, d):
    return ot.rule_stats(ot.rewrite_documents(view(spark, d, "v_jdocs")), ["lang"])


# ---- line joins: words of the kana texts, next to one another -------------------------------
VIEW_SQL["v_words"] = """
SELECT conv_id, turn, CAST(i AS INT) AS word_no, ws[i + 1] AS word FROM (SELECT conv_id, turn, string_split(text, '、') AS ws FROM v_kana), unnest(range(len(ws))) AS u(i)"""
VIEW_SQL["v_joins"] = """
SELECT conv_id, turn, word_no, word AS l, nxt AS r FROM (SELECT *, lead(word) OVER (PARTITION BY conv_id, turn ORDER BY word_no) AS nxt FROM v_words) WHERE nxt IS NOT NULL"""


def _joins(spark, d):
    """Neighbouring words; both lie in one row, so no shuffle is needed."""
    words = F.split("text", "、")
    return view(spark, d, "v_kana").select("conv_id", "turn", words.alias("ws")).select(
        "conv_id", "turn", "ws", F.posexplode("ws").alias("word_no", "l")).where(F.col("word_no") + 1 < F.size("ws")).select(
        "conv_id", "turn", "word_no", "l", F.element_at("ws", F.col("word_no") + 2).alias("r"))


def cls(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]^-\\&" else c for c in chars) + "]"


def alt(tokens: list[str]) -> str:
    return "(?:" + "|".join(tokens) + ")"


WS = "' ' || chr(10) || chr(9) || chr(13) || '　'"
TOKEN_RE = tx.PROTECTED_TOKEN.replace("(?U)", "").replace("\\uff", "\\x{ff").replace("'", "''")


def aliases_sql(l: str, r: str) -> str:
    a, b = f"rtrim({l}, {WS})", f"ltrim({r}, {WS})"
    la, fb = f"right({a}, 1)", f"left({b}, 1)"
    url = f"regexp_matches(concat({a}, {b}), '^https?://[^\\s]+$')"
    polite = f"(regexp_matches({b}, '^{alt(tx.POLITE[0])}') OR regexp_matches({a}, '{alt(tx.POLITE[1])}$'))"
    verb = f"(regexp_matches({b}, '^{alt(tx.VERB_AUX[0])}') OR regexp_matches({a}, '{alt(tx.VERB_AUX[1])}$'))"
    cnt = lambda c, ch: f"(length({c}) - length(replace({c}, '{ch}', '')))"
    pair = " OR ".join(f"({cnt(a, o)} > {cnt(a, c)} AND {cnt(b, c)} > {cnt(b, o)})" for o, c in tx.BRACKETS)
    return (f"CASE WHEN {a} = '' OR {b} = '' THEN '' ELSE concat_ws(',', CASE WHEN regexp_matches({la}, '^[0-9]$') AND regexp_matches({fb}, '^[0-9]$') THEN 'SAFE-WRAP-DIGIT-SPLIT-01' END, CASE WHEN {url} THEN 'SAFE-WRAP-URL-SPLIT-01' END, "
            f"CASE WHEN regexp_matches({la}, '^[A-Za-z]$') AND regexp_matches({fb}, '^[A-Za-z]$') AND NOT {url} THEN 'SAFE-WRAP-ENGLISH-SPLIT-01' END, "
            f"CASE WHEN starts_with({b}, 'する') AND regexp_matches({la}, '^[一-龯々〆ヵヶァ-ヴー]$') THEN 'SAFE-WRAP-NOUN-SURU-SPLIT-01' END, CASE WHEN {polite} THEN 'SAFE-WRAP-POLITE-FORM-SPLIT-01' END, "
            f"CASE WHEN NOT {polite} AND {verb} THEN 'SAFE-WRAP-VERB-AUX-SPLIT-01' END, CASE WHEN {pair} THEN 'SAFE-WRAP-BRACKET-PAIR-BOUNDARY-01' END) END")


def kind_cte(src: str, keys: str) -> str:
    """Adds kind, allowed, rule_ids and preference to rows with texts l and r."""
    parts = f"list_filter(string_split(replace(replace(mk, chr(64976), concat(chr(64978), chr(64976))), chr(64977), concat(chr(64977), chr(64978))), chr(64978)), lambda q: q <> '')"
    clean = "length(replace(replace(q, chr(64976), ''), chr(64977), ''))"
    ids = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.RULE_IDS.items())
    al = ", ".join(f"'{k}'" for k in tx.ALIASED)
    part = alt(tx.PARTICLES)
    return f"""
k0 AS (SELECT {keys}, l, r, rtrim(l, {WS}) AS a, ltrim(r, {WS}) AS b FROM {src}),
k1 AS (SELECT *, concat(a, b) AS txt, length(a) AS ix, regexp_replace(concat(a, b), '({TOKEN_RE})', concat(chr(64976), '\\1', chr(64977)), 'g') AS mk FROM k0),
k2 AS (SELECT *, {parts} AS ps FROM k1),
k3 AS (SELECT *, list_bool_or(list_transform(ps, lambda p, i: starts_with(p, chr(64976)) AND coalesce(list_sum(list_transform(ps[1:i - 1], lambda q: {clean})), 0) < ix
      AND ix < coalesce(list_sum(list_transform(ps[1:i], lambda q: {clean})), 0))) AS prot FROM k2),
k4 AS (SELECT *, CASE WHEN ix <= 0 OR ix >= length(txt) THEN 'edge' WHEN prot THEN 'protected-token' WHEN regexp_matches(right(a, 1), '{cls(tx.OPENING)}') THEN 'opening-bracket-end' WHEN regexp_matches(left(b, 1), '{cls(tx.FORBIDDEN_HEAD)}') THEN 'forbidden-line-head'
   WHEN regexp_matches(b, '^{alt(tx.AUXILIARY_HEADS)}') OR regexp_matches(a, '{alt(tx.LEFT_SUFFIXES)}$') THEN 'verb-auxiliary' WHEN regexp_matches(b, '^{part}') THEN 'stranded-particle'
   WHEN regexp_matches(right(a, 1), '{tx.KANJI}') AND regexp_matches(left(b, 1), '{tx.HIRAGANA}') THEN 'kanji-okurigana' WHEN regexp_matches(right(a, 1), '{tx.HIRAGANA}') AND regexp_matches(left(b, 1), '{tx.HIRAGANA}') THEN 'contiguous-hiragana'
   WHEN regexp_matches(a, '{part}$') AND length(b) <= 4 AND regexp_matches(left(b, 1), '[\\x{{3000}}-\\x{{9fff}}\\x{{ff00}}-\\x{{ffef}}]') THEN 'short-predicate-isolation' WHEN regexp_matches(right(a, 1), '{cls(tx.SENTENCE_END)}') THEN 'sentence'
   WHEN regexp_matches(right(a, 1), '{cls(tx.SYMBOL_AFTER)}') AND ix = 1 AND regexp_matches(left(txt, 1), '{cls(tx.BULLETS)}') THEN 'bullet-prefix' WHEN regexp_matches(right(a, 1), '{cls(tx.SYMBOL_AFTER)}') THEN 'symbol-after'
   WHEN regexp_matches(substr(txt, ix, 2), '\\s') THEN 'space' WHEN regexp_matches(a, '{part}$') THEN 'particle-ending' WHEN regexp_matches(left(b, 1), '{cls(tx.OPENING)}') THEN 'before-opening'
   WHEN regexp_matches(right(a, 1), '[\\x{{3000}}-\\x{{9fff}}\\x{{ff00}}-\\x{{ffef}}]') AND regexp_matches(left(b, 1), '[\\x{{3000}}-\\x{{9fff}}\\x{{ff00}}-\\x{{ffef}}]') THEN 'ambiguous-japanese' ELSE 'ambiguous' END AS kind, {aliases_sql('l', 'r')} AS al FROM k3),
kk AS (SELECT *, kind IN ('sentence','symbol-after','space','particle-ending','before-opening') AS allowed, CASE WHEN kind IN ('sentence','symbol-after','space','particle-ending','before-opening') THEN '' WHEN kind IN ({al}) AND al <> '' THEN al
   ELSE concat_ws(',', nullif(al, ''), CASE kind {ids} END) END AS rule_ids,
   CASE kind WHEN 'sentence' THEN 0.0 WHEN 'symbol-after' THEN 1.0 WHEN 'space' THEN 2.0 WHEN 'particle-ending' THEN CASE WHEN regexp_extract(a, '({part})$', 1) = 'の' THEN 6.0 ELSE 4.0 END WHEN 'before-opening' THEN 8.0 ELSE 30.0 END::DOUBLE AS preference FROM k4)"""


@query("t14_classify_boundary", f"WITH {kind_cte('v_joins', 'conv_id, turn, word_no')} SELECT conv_id, turn, word_no, kind, allowed, rule_ids, preference FROM kk")
def t14(spark, d):
    out = ot.classify_boundary(_joins(spark, d), "l", "r")
    return out.select("conv_id", "turn", "word_no", "kind", "allowed", F.array_join("rule_ids", ",").alias("rule_ids"), "preference")


@query("t15_boundary_aliases", f"SELECT conv_id, turn, word_no, {aliases_sql('l', 'r')} AS aliases FROM v_joins")
def t15(spark, d):
    return _joins(spark, d).select("conv_id", "turn", "word_no", F.array_join(tx.boundary_aliases(F.col("l"), F.col("r")), ",").alias("aliases"))


@query("sql_line_join_aliases", f"SELECT conv_id, turn, word_no, {aliases_sql('l', 'r')} AS aliases FROM v_joins")
def sql_aliases(spark, d):
    fsql.register(spark)
    return _joins(spark, d).selectExpr("conv_id", "turn", "word_no", "array_join(line_join_aliases(l, r), ',') AS aliases")


FRAME = "conv_id AS frame_id, turn AS line_index, CAST(floor(turn / 4) AS INT) AS paragraph, text"


@query("t16_rendered_line_boundaries", f"""
WITH f AS (SELECT {FRAME} FROM v_kana), p AS (SELECT *, lead(text) OVER w AS nt, lead(paragraph) OVER w AS np FROM f WINDOW w AS (PARTITION BY frame_id ORDER BY line_index)),
src AS (SELECT frame_id, line_index, text AS l, nt AS r FROM p WHERE np = paragraph AND (frame_id + line_index) % 5 <> 0), {kind_cte('src', 'frame_id, line_index')}
SELECT frame_id, line_index, sha256(regexp_replace(l, '\\s+', '', 'g')) AS left_hash, sha256(regexp_replace(r, '\\s+', '', 'g')) AS right_hash, allowed, kind, rule_ids FROM kk""")
def t16(spark, d):
    lines = view(spark, d, "v_kana").selectExpr(*_split(FRAME))
    return ot.line_boundaries(lines, lines.where("(frame_id + line_index) % 5 = 0"))


@query("t16_boundary_status", f"""
WITH f AS (SELECT {FRAME} FROM v_kana), p AS (SELECT *, lead(text) OVER w AS nt, lead(paragraph) OVER w AS np FROM f WINDOW w AS (PARTITION BY frame_id ORDER BY line_index)),
src AS (SELECT frame_id, line_index, text AS l, nt AS r FROM p WHERE np = paragraph), {kind_cte('src', 'frame_id, line_index')}
SELECT frame_id, count(*) AS boundary_count, count(*) FILTER (WHERE NOT allowed) AS blocked, CASE WHEN bool_or(NOT allowed) THEN 'block' ELSE 'pass' END AS status FROM kk GROUP BY 1""")
def t16_status(spark, d):
    return ot.boundary_status(ot.line_boundaries(view(spark, d, "v_kana").selectExpr(*_split(FRAME))))


@query("t17_explicit_break_lint", f"""
WITH s AS (SELECT conv_id, turn, string_split(text, '・') AS ws FROM v_kana),
src AS (SELECT concat_ws('-', conv_id::VARCHAR, turn::VARCHAR) AS paragraph_id, CAST(2 * i - 1 AS INT) AS break_index, array_to_string(ws[1:i], '') AS l, array_to_string(ws[i + 1:], '') AS r FROM s, unnest(range(1, len(ws))) AS u(i)),
{kind_cte('src', 'paragraph_id, break_index')}
SELECT paragraph_id, break_index, CASE WHEN contains(rule_ids, 'SAFE-WRAP-DIGIT-SPLIT-01') THEN 'manual_break_number_split' WHEN contains(rule_ids, 'SAFE-WRAP-URL-SPLIT-01') OR contains(rule_ids, 'SAFE-WRAP-ENGLISH-SPLIT-01') THEN 'manual_break_word_split'
 WHEN regexp_matches(right(a, 1), '[①-⑳]') OR regexp_matches(left(b, 1), '[①-⑳]') THEN 'manual_break_circled_number_split' WHEN regexp_matches(rule_ids, 'OPENING-BRACKET-END|FORBIDDEN-LINE-HEAD|BRACKET-PAIR') THEN 'manual_break_bracket_or_punctuation_split'
 WHEN contains(rule_ids, 'STRANDED-PARTICLE') THEN 'manual_break_particle_split' ELSE 'manual_break_inside_japanese_phrase' END AS rule, kind FROM kk WHERE NOT allowed AND a <> '' AND b <> ''""")
def t17(spark, d):
    parts = F.split("text", "・")
    woven = F.flatten(F.transform(parts, lambda p, i: F.when(i > 0, F.array(F.lit(None).cast("string"), p)).otherwise(F.array(p))))
    return ot.break_lint(view(spark, d, "v_kana").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("paragraph_id"), woven.alias("segments")))


VIEW_SQL["v_klines"] = "SELECT conv_id, turn, word_no, word AS text, (conv_id + word_no) % 3 = 0 AS bold FROM v_words"


@query("t18_line_lint", """
WITH x AS (SELECT conv_id, turn, word_no, text, bold FROM v_klines)
SELECT conv_id, turn, word_no, 'circled_number_bold' AS rule FROM x WHERE regexp_matches(left(text, 1), '[①-⑳]') AND bold
UNION ALL SELECT conv_id, turn, word_no, 'orphan_particle_or_punctuation' FROM x WHERE length(text) = 1 AND contains('はがをにへとやもののでからよりまでだけしかでもまた、。！？）］】」』', text)
UNION ALL SELECT conv_id, turn, word_no, 'opening_bracket_at_line_end' FROM x WHERE regexp_matches(right(text, 1), '[（［【「『]')
UNION ALL SELECT conv_id, turn, word_no, 'closing_bracket_at_line_start' FROM x WHERE regexp_matches(left(text, 1), '[）］】」』]')
UNION ALL SELECT conv_id, turn, word_no, 'circled_number_separated' FROM x WHERE length(text) = 1 AND regexp_matches(text, '[①-⑳]')""")
def t18(spark, d):
    words = view(spark, d, "v_kana").select("conv_id", "turn", F.posexplode(F.split("text", "、")).alias("word_no", "text"))
    return ot.line_lint(words.withColumn("bold", F.expr("(conv_id + word_no) % 3 = 0")), ["conv_id", "turn", "word_no"])


@query("t19_split_word_candidate", """
WITH q AS (SELECT doc_id, line_no, regexp_replace(line, '[.]$', '') AS line FROM v_lines), p AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nl FROM q),
t AS (SELECT doc_id, line_no, string_split(rtrim(line), ' ')[-1] AS left_token, string_split(ltrim(nl), ' ')[1] AS right_token FROM p WHERE nl IS NOT NULL)
SELECT * FROM t WHERE regexp_matches(left_token, '^[A-Za-z]{2,4}$') AND regexp_matches(right_token, '^[A-Za-z]{2,4}$') AND length(left_token) + length(right_token) <= 8""")
def t19(spark, d):
    lines = view(spark, d, "v_lines").withColumnRenamed("line", "text").withColumn("text", F.regexp_replace("text", r"\.$", ""))
    return ot.split_words(lines, ["doc_id"], ["line_no"], F.floor(F.col("line_no") / 4096))


SFL = ("artifact_id, page, CAST(block_id % 2 AS INT) AS block_id, line_index, box_id, x0 / 4 AS x0, y0, x1 / 4 + CASE WHEN line_index <= 3 THEN 300 ELSE 0 END AS x1, y1, bold AND curves % 2 = 0 AS bold, "
       "substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(CASE WHEN line_index > 4 THEN curves ELSE 13 + curves END AS INT)) AS text")


JUDGED = f"""b AS (SELECT {SFL} FROM v_boxes),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY artifact_id, page, block_id) AS n, lag(box_id) OVER w AS pid, lag(text) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, min(x0) OVER (PARTITION BY artifact_id, page, block_id) AS lo,
  max(x1) OVER (PARTITION BY artifact_id, page, block_id) AS hi, bool_and(bold) OVER (PARTITION BY artifact_id, page, block_id) AS ab, first_value(text) OVER w AS ft, first_value(x0) OVER w AS fx, nth_value(x0, 2) OVER (PARTITION BY artifact_id, page, block_id ORDER BY line_index, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sx
  FROM b WINDOW w AS (PARTITION BY artifact_id, page, block_id ORDER BY line_index, box_id)),
k AS (SELECT o.*, width, least(x0, px0) AS ux0, least(y0, py0) AS uy0, greatest(x1, px1) AS ux1, greatest(y1, py1) AS uy1 FROM o JOIN v_pages p ON p.artifact_id = o.artifact_id AND p.page = o.page
  WHERE n >= 2 AND NOT ab AND NOT (length(ft) <= 12 AND abs(fx - sx) > 20) AND NOT (hi - lo < width * 0.4))"""


@query("t19_split_in_blocks", f"""
WITH {JUDGED} SELECT artifact_id, page, block_id, pid AS previous_id, box_id AS current_id, ux0 AS x0, uy0 AS y0, ux1 AS x1, uy1 AS y1 FROM k
WHERE pt IS NOT NULL AND length(pt) BETWEEN 2 AND 4 AND length(text) BETWEEN 2 AND 4""")
def t19_blocks(spark, d):
    return ot.split_candidates(view(spark, d, "v_boxes").selectExpr(*_split(SFL)), view(spark, d, "v_pages"))


@query("t20_short_final_line", f"""
WITH {JUDGED} SELECT artifact_id, page, block_id, pid AS previous_id, box_id AS final_id, unnest(['short_final_line_candidate', CASE WHEN px1 - px0 >= width * 0.6 THEN 'automatic_wrap_anomaly_candidate' ELSE 'manual_break_anomaly_candidate' END]) AS rule,
  ux0 AS x0, uy0 AS y0, ux1 AS x1, uy1 AS y1 FROM k WHERE i = n AND length(text) <= 4 AND length(pt) >= 12 AND x1 - x0 <= (px1 - px0) * 0.45""")
def t20(spark, d):
    return ot.short_final(view(spark, d, "v_boxes").selectExpr(*_split(SFL)), view(spark, d, "v_pages"))


CIRC = "artifact_id, page, block_id, box_id, font, bold, CASE WHEN curves < 6 THEN concat(chr(9312 + curves), 'x') ELSE 'plain' END AS text"
CIRC_S = CIRC.replace("chr(9312 + curves)", "substring('①②③④⑤⑥⑦⑧⑨', curves + 1, 1)")


@query("t21_list_style_consistency", f"""
WITH i AS (SELECT * FROM (SELECT {CIRC} FROM v_boxes) WHERE regexp_matches(left(text, 1), '[①-⑳]')), g AS (SELECT artifact_id, page, block_id, count(DISTINCT font) AS f, count(DISTINCT bold) AS w FROM i GROUP BY ALL HAVING count(*) >= 2)
SELECT artifact_id, page, block_id, 'font_family_inconsistent' AS rule FROM g WHERE f > 1 UNION ALL SELECT artifact_id, page, block_id, 'font_weight_inconsistent' FROM g WHERE w > 1""")
def t21(spark, d):
    return ot.list_style(view(spark, d, "v_boxes").selectExpr(*_split(CIRC_S)))


ITEM = ("concat('i', CAST(doc_id - CASE WHEN doc_id % 41 = 1 THEN 1 ELSE 0 END AS STRING)) AS item_id, CASE WHEN doc_id % 7 = 0 THEN 'internal' ELSE 'visible' END AS visibility, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'scope-only' WHEN 1 THEN 'uncertainty-meta' ELSE 'action' END AS statement_kind, "
        "CASE WHEN doc_id % 3 = 0 THEN 'safety' END AS constraint_reason, CASE WHEN doc_id % 11 = 0 THEN text END AS explicit_text, doc_id % 22 = 0 AS explicit_supported, doc_id % 44 = 0 AS explicit_action_object, "
        "CASE WHEN doc_id % 2 = 0 THEN lang END AS purpose, CASE WHEN doc_id % 4 < 2 THEN source END AS object, CASE WHEN doc_id % 6 = 1 THEN 'team' END AS recipient, CASE WHEN doc_id % 8 = 3 THEN 'mail' END AS means, "
        "CASE WHEN doc_id % 9 = 4 THEN 'news。' END AS contact_content, CASE WHEN doc_id % 10 < 7 THEN 'send. ' END AS action")
SUP_S = "IF(doc_id % 13 = 0, array('purpose', 'object'), array('purpose', 'object', 'recipient', 'means', 'contact_content', 'action')) AS supported"
SUP_D = "CASE WHEN doc_id % 13 = 0 THEN ['purpose', 'object'] ELSE ['purpose', 'object', 'recipient', 'means', 'contact_content', 'action'] END AS supported"


@query("t22_visible_text_policy", f"""
WITH i AS (SELECT {ITEM}, doc_id % 13 = 0 AS lim FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY item_id) > 1 AS rep, (action IS NOT NULL AND object IS NOT NULL) OR (explicit_text IS NOT NULL AND explicit_action_object) AS concrete,
  concat(regexp_replace(concat_ws('、', purpose || 'ため', recipient || 'に', object || 'を', means || 'で', contact_content, action), '[。.!！?]+$', ''), '。') AS comp FROM i),
h AS (SELECT *, visibility = 'internal' OR (statement_kind IN ('scope-only', 'uncertainty-meta') AND NOT concrete) AS hidden FROM c), t AS (SELECT *, CASE WHEN NOT hidden THEN coalesce(explicit_text, comp) END AS tx FROM h),
m AS (SELECT *, trim(tx, {WS}) AS s, regexp_replace(trim(tx, {WS}), '[。！？!?]+', chr(64976), 'g') AS z FROM t),
o AS (SELECT *, CASE WHEN (lim AND (recipient IS NOT NULL OR means IS NOT NULL OR contact_content IS NOT NULL OR action IS NOT NULL)) OR (explicit_text IS NOT NULL AND NOT explicit_supported) THEN 'unsupported_facts'
   WHEN tx IS NOT NULL AND NOT (NOT contains(s, chr(10)) AND (length(z) - length(replace(z, chr(64976), '')) = 0 OR (length(z) - length(replace(z, chr(64976), '')) = 1 AND right(z, 1) = chr(64976)))) THEN 'more_than_one_meaning'
   WHEN rep THEN 'duplicate_id' WHEN visibility = 'internal' THEN 'visibility_internal' WHEN hidden THEN 'meta_without_concrete_action' WHEN coalesce(constraint_reason = 'safety', false) AND concrete THEN 'preserved_constraint' ELSE 'source_supported_visible_text' END AS reason_code FROM m)
SELECT item_id, reason_code, CASE WHEN reason_code IN ('preserved_constraint', 'source_supported_visible_text') THEN tx END AS text FROM o""")
def t22(spark, d):
    return ot.visible_text(load(spark, d, "documents").selectExpr(*_split(ITEM), SUP_S))


@query("t23_single_meaning", r"""
WITH s AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS t FROM v_lines), m AS (SELECT *, regexp_replace(t, '[。！？!?]+', chr(64976), 'g') AS z FROM s)
SELECT doc_id, line_no, length(z) - length(replace(z, chr(64976), '')) = 0 OR (length(z) - length(replace(z, chr(64976), '')) = 1 AND right(z, 1) = chr(64976)) AS single FROM m""")
def t23(spark, d):
    return view(spark, d, "v_lines").select("doc_id", "line_no", tx.single_meaning(F.col("line")).alias("single"))


@query("sql_single_meaning", r"""
WITH s AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS t FROM v_lines), m AS (SELECT *, regexp_replace(t, '[。！？!?]+', chr(64976), 'g') AS z FROM s)
SELECT doc_id, line_no, length(z) - length(replace(z, chr(64976), '')) = 0 OR (length(z) - length(replace(z, chr(64976), '')) = 1 AND right(z, 1) = chr(64976)) AS single FROM m""")
def sql_single_meaning(spark, d):
    fsql.register(spark)
    return view(spark, d, "v_lines").selectExpr("doc_id", "line_no", "single_meaning(line) AS single")


@query("t24_min_line_spacing", "SELECT artifact_id, box_id, CASE WHEN line_index % 3 < 2 THEN greatest(CASE WHEN curves > 0 THEN 8.0 + curves END, 12.0) ELSE CASE WHEN curves > 0 THEN 8.0 + curves END END::DOUBLE AS spacing FROM v_boxes")
def t24(spark, d):
    rows = view(spark, d, "v_boxes").selectExpr("artifact_id", "box_id", "element_at(array('body', 'role-list', 'heading'), line_index % 3 + 1) AS role", "IF(curves > 0, 8.0D + curves, NULL) AS requested")
    return rows.select("artifact_id", "box_id", ot.min_line_spacing(F.col("role"), F.col("requested")).alias("spacing"))


@query("t25_pii_scan", r"""
SELECT doc_id, 'text' AS field, unnest(regexp_extract_all(text, '(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\p{Nd}[\p{Nd} ()-]{7,}\p{Nd})')) AS match FROM documents""")
def t25(spark, d):
    return ot.pii_scan(load(spark, d, "documents").withColumn("path", F.col("source")), ["doc_id"], ["text", "path"])


@query("t26_line_hash", r"SELECT doc_id, line_no, sha256(regexp_replace(line, '\s+', '', 'g')) AS line_hash FROM v_lines")
def t26_hash(spark, d):
    return view(spark, d, "v_lines").select("doc_id", "line_no", tx.line_hash(F.col("line")).alias("line_hash"))


REND = "doc_id AS frame_id, CAST(line_no AS INT) AS line_no, CASE WHEN doc_id % 17 = 0 AND line_no = 1 THEN concat(line, 'x') WHEN doc_id % 19 = 0 THEN concat(' ', line, ' ') ELSE line END AS text"


@query("t26_plan_parity", f"""
WITH p AS (SELECT doc_id AS frame_id, line_no, sha256(regexp_replace(line, '\\s+', '', 'g')) AS h FROM v_lines WHERE NOT (doc_id % 23 = 0 AND line_no = 0)), r AS (SELECT frame_id, line_no, sha256(regexp_replace(text, '\\s+', '', 'g')) AS h FROM (SELECT {REND} FROM v_lines)),
j AS (SELECT frame_id, p.h AS ph, r.h AS rh FROM p FULL JOIN r USING (frame_id, line_no))
SELECT frame_id, count(ph) AS planned_lines, count(rh) AS rendered_lines, count(*) FILTER (WHERE ph IS DISTINCT FROM rh) AS different FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE ph IS DISTINCT FROM rh) > 0""")
def t26(spark, d):
    lines = view(spark, d, "v_lines")
    planned = lines.where("NOT (doc_id % 23 = 0 AND line_no = 0)").selectExpr("doc_id AS frame_id", "line_no", "line AS text")
    return ot.plan_parity(planned, lines.selectExpr(*_split(REND)))


WL = ("concat_ws('-', CAST(doc_id AS STRING), CAST(line_no AS STRING)) AS line_id, CASE WHEN doc_id % 2 = 0 THEN 'f1' ELSE 'f2' END AS font, line AS text, line_no > 0 AS is_continuation, CAST(60 * (1 + doc_id % 40) AS DOUBLE) AS frame_width, "
      "CAST(10 AS DOUBLE) AS margin_left, CAST(doc_id % 3 * 5 AS DOUBLE) AS margin_right, CAST(8 + doc_id % 4 AS DOUBLE) AS size")


@query("t27_line_width_overflow", f"""
WITH l AS (SELECT {WL} FROM v_lines), ch AS (SELECT line_id, font, line_no_i AS i, substr(text, line_no_i + 1, 1) AS ch FROM (SELECT line_id, font, text, unnest(range(length(text))) AS line_no_i FROM l)),
mt AS (SELECT x.f AS font, chr(CAST(97 + y.i AS INT)) AS ch, CASE WHEN x.f = 'f1' THEN 0.5 ELSE 0.25 END + (y.i % 4) / 8.0 AS advance FROM (VALUES ('f1'), ('f2')) x(f), (SELECT unnest(range(26)) AS i) y UNION ALL SELECT 'f1', ' ', 0.25 UNION ALL SELECT 'f2', ' ', 0.25),
w AS (SELECT line_id, sum(advance)::DOUBLE AS u, count(DISTINCT CASE WHEN advance IS NULL THEN ch.ch END) AS unknown FROM ch LEFT JOIN mt ON mt.font = ch.font AND mt.ch = ch.ch GROUP BY 1),
m AS (SELECT l.line_id, coalesce(u, 0.0::DOUBLE) * size AS width, (frame_width - margin_left - margin_right) * 0.90::DOUBLE AS safe, coalesce(unknown, 0) AS unknown_chars, is_continuation FROM l LEFT JOIN w USING (line_id))
SELECT line_id, {pr('width', 4)} AS width, {pr('safe', 4)} AS safe_width, CASE WHEN safe > 0 THEN {pr('width / safe', 4)} END AS ratio, unknown_chars, concat_ws(',', CASE WHEN safe <= 0 THEN 'SAFE-WRAP-GEOMETRY-01' END, CASE WHEN safe > 0 AND width > safe THEN 'SAFE-WRAP-IMPLICIT-OVERFLOW-01' END,
  CASE WHEN safe > 0 AND is_continuation AND width / safe < 0.30 THEN 'rendered_orphan_ratio' END) AS failures FROM m""")
def t27(spark, d):
    letters = [(f, chr(97 + i), (0.5 if f == "f1" else 0.25) + i % 4 / 8) for f in ("f1", "f2") for i in range(26)]
    metrics = spark.createDataFrame(letters + [("f1", " ", 0.25), ("f2", " ", 0.25)], "font string, ch string, advance double")
    return ot.line_widths(view(spark, d, "v_lines").selectExpr(*_split(WL)), metrics)


FRM = ("o_orderkey AS frame_id, CASE WHEN o_custkey % 17 = 0 THEN 'block' ELSE 'pass' END AS status, CAST(CASE WHEN o_custkey % 19 = 0 THEN 1 ELSE 0 END AS INT) AS n_rules, CAST(200 + o_custkey % 5 AS DOUBLE) AS frame_width, CASE WHEN o_custkey % 23 = 0 THEN 0.0 ELSE 10.0 END AS font_size, "
       "CAST((180 + o_custkey % 5) * 0.9 + CASE WHEN o_custkey % 7 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS safe_width, 12.0 AS line_height, CAST(30 + o_custkey % 9 AS DOUBLE) AS total_height, CAST(2 + o_custkey % 2 AS INT) AS line_count, "
       "CAST(3 - CASE WHEN o_custkey % 29 = 0 THEN 2 ELSE 0 END AS INT) AS max_lines, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 36.0 END AS max_height, o_custkey % 31 = 0 AS shrink")


@query("t28_wrap_receipt_check", """
SELECT frame_id, CASE WHEN o % 17 = 0 OR o % 19 = 0 THEN 'AQ-SAFE-WRAP-FRAMES-01' WHEN o % 23 = 0 THEN 'SAFE-WRAP-GEOMETRY-01' ELSE concat_ws(',', CASE WHEN o % 7 = 0 THEN 'SAFE-WRAP-GEOMETRY-01' END, CASE WHEN o % 13 = 0 THEN 'SAFE-WRAP-IMPLICIT-OVERFLOW-01' END,
  CASE WHEN 2 + o % 2 <> 2 OR o % 29 = 0 THEN 'SAFE-WRAP-MAX-LINES-01' END, CASE WHEN o % 3 <> 0 AND 30 + o % 9 > 36.01 THEN 'SAFE-WRAP-MAX-HEIGHT-01' END, CASE WHEN o % 31 = 0 THEN 'SAFE-WRAP-NO-FONT-SHRINK-01' END) END AS failures
FROM (SELECT o_orderkey AS frame_id, o_custkey AS o FROM orders)""")
def t28(spark, d):
    return ot.wrap_check(load(spark, d, "orders").selectExpr(*_split(FRM), "array(10D, 10D) AS margins", "IF(o_custkey % 13 = 0, array(100D, 400D), array(100D, 120D)) AS widths"))


@query("t29_change_list_replay", """
WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', '_') ELSE replace(concat('@1 ', text, ' @2'), '@1 ', 'one ') END AS t0 FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'edit_list_missing' WHEN doc_id % 11 = 0 THEN 'edit_not_unique' WHEN doc_id % 13 = 0 THEN 'target_differs' ELSE 'pass' END AS outcome FROM e""")
def t29(spark, d):
    edit = lambda b, a: f"named_struct('before', {b}, 'after', {a})"
    good = f"array({edit(chr(39) + '@@1 ' + chr(39), chr(39) + 'one @@3 ' + chr(39))}, {edit(chr(39) + '@@3' + chr(39), chr(39) + 'three' + chr(39))}, {edit(chr(39) + ' @@2' + chr(39), chr(39) + ' two' + chr(39))})"
    twice = f"array({edit(chr(39) + '@@' + chr(39), chr(39) + 'x' + chr(39))})"
    return ot.replay_edits(load(spark, d, "documents").selectExpr(
        "doc_id", "concat('@@1 ', text, ' @@2') AS source", "concat('one three ', text, IF(doc_id % 13 = 0, ' tw', ' two')) AS target",
        f"CASE WHEN doc_id % 7 = 0 THEN filter({good}, x -> false) WHEN doc_id % 11 = 0 THEN {twice} ELSE {good} END AS edits"))


# ---- HTML ------------------------------------------------------------------------------------
TOKENS_RE = r"(?is)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|</?[a-z][^>]*>|[^<]+"
VIEW_SQL["v_html_raw"] = f"SELECT page_id, unnest(regexp_extract_all(html, '{TOKENS_RE}')) AS raw, unnest(range(len(regexp_extract_all(html, '{TOKENS_RE}')))) AS n FROM pages"
VIEW_SQL["v_html_tokens"] = r"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n, k) - 1 AS INT) AS pos, raw, CASE WHEN starts_with(raw, '<!--') THEN 'comment' WHEN starts_with(raw, '<!') THEN 'decl' WHEN regexp_matches(raw, '^</[A-Za-z]') THEN 'end' WHEN regexp_matches(raw, '(?s)^<[A-Za-z].*/>$') THEN 'void'
  WHEN regexp_matches(raw, '^<[A-Za-z]') THEN 'start' ELSE 'text' END AS kind, lower(regexp_extract(raw, '^</?([A-Za-z][^\s/>]*)', 1)) AS tag FROM (
 SELECT page_id, n, 0 AS k, raw FROM v_html_raw WHERE NOT regexp_matches(raw, '(?is)^<(script|style)[^>]*>.*</(script|style)\s*>$')
 UNION ALL SELECT page_id, n, 0, regexp_extract(raw, '^<[^>]*>') FROM v_html_raw WHERE regexp_matches(raw, '(?is)^<(script|style)[^>]*>.*</(script|style)\s*>$')
 UNION ALL SELECT page_id, n, 1, regexp_extract(raw, '(?s)^<[^>]*>(.*)</[A-Za-z]+\s*>$', 1) FROM v_html_raw WHERE regexp_matches(raw, '(?is)^<(script|style)[^>]*>.+</(script|style)\s*>$') AND regexp_extract(raw, '(?s)^<[^>]*>(.*)</[A-Za-z]+\s*>$', 1) <> ''
 UNION ALL SELECT page_id, n, 2, regexp_extract(raw, '</[A-Za-z]+\s*>$') FROM v_html_raw WHERE regexp_matches(raw, '(?is)^<(script|style)[^>]*>.*</(script|style)\s*>$'))"""


DECODED = "replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query("h1_html_tokens", f"""
SELECT page_id, pos, kind, tag, raw, CASE WHEN kind = 'text' THEN CASE WHEN lag(tag) OVER (PARTITION BY page_id ORDER BY pos) IN ('script', 'style') AND lag(kind) OVER (PARTITION BY page_id ORDER BY pos) = 'start' THEN raw
  ELSE regexp_replace({DECODED}, '&amp$', '&') END END AS text FROM v_html_tokens""")
def h1(spark, d):
    return ht.html_tokens(text_rows(spark, d, "pages", "page_id")).drop("attrs")


ATTRS = r"""SELECT page_id, pos, tag, unnest(regexp_extract_all(regexp_replace(raw, '^<[A-Za-z][^\s/>]*', ''), '([a-zA-Z-]+)="([^"]*)"', 1)) AS name, unnest(regexp_extract_all(regexp_replace(raw, '^<[A-Za-z][^\s/>]*', ''), '([a-zA-Z-]+)="([^"]*)"', 2)) AS value FROM v_html_tokens WHERE kind IN ('start', 'void')"""


@query("h1_html_attributes", ATTRS)
def h1_attrs(spark, d):
    tokens = ht.html_tokens(text_rows(spark, d, "pages", "page_id")).where("attrs IS NOT NULL")
    return tokens.select("page_id", "pos", "tag", F.inline("attrs"))


FORB = ", ".join(f"'{t}'" for t in ht.FORBIDDEN_TAGS)
ALLOW = ", ".join(f"'{t}'" for t in ht.ALLOWED_TAGS)
VOID = ", ".join(f"'{t}'" for t in ht.VOID_TAGS)


@query("h2_tag_policy", f"""
SELECT page_id, pos, tag, CASE WHEN kind = 'decl' THEN 'declaration' WHEN tag IN ({FORB}) THEN 'forbidden' ELSE 'unsupported' END AS reason FROM v_html_tokens WHERE kind = 'decl' OR (kind IN ('start', 'void') AND (tag IN ({FORB}) OR tag NOT IN ({ALLOW})))""")
def h2(spark, d):
    return ht.tag_policy(ht.html_tokens(text_rows(spark, d, "pages", "page_id")))


# plain, numeric and named spellings of one script address
UNSAFE_HTML = ("replace(replace(html, '<div class=', '<div onClick=\"x\" class='), 'href=\"/th', CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'href=\" JavaScript:/th' WHEN 1 THEN 'href=\"java&#115;cript:/th' "
               "WHEN 2 THEN 'href=\"javascript&colon;/th' ELSE 'href=\"&#x6A;avascript&#x3a/th' END)")


@query("h3_attr_policy", f"""
WITH t AS (SELECT page_id, pos, tag, name, value FROM ({ATTRS})), dv AS (SELECT page_id, pos, tag FROM t WHERE tag = 'div' AND name = 'class')
SELECT page_id, pos, tag, 'onclick' AS name, 'event_handler' AS reason FROM dv UNION ALL SELECT page_id, pos, tag, name, 'javascript_url' FROM t WHERE name = 'href' AND starts_with(value, '/th')""")
def h3(spark, d):
    return ht.attr_policy(ht.html_tokens(text_rows(spark, d, "pages", "page_id").withColumn("html", F.expr(UNSAFE_HTML))))


REFERENCES = {"&#128;": "€", "a&#1;b": "ab", "java&#x0B;script": "javascript", "&#0;&#xD800;&#1114112;": "\ufffd\ufffd\ufffd", "&#x92;&amp;&#127;": "’&", "&#129;|&#xFFFE;|&#9;": "\x81||\t", "&notit;&copy&bogus;": "¬it;©&bogus;"}


@query("h1_references", "SELECT page_id, CASE CAST(page_id % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(REFERENCES.values())) + " END AS text FROM pages")
def h1_references(spark, d):
    piece = F.element_at(F.array(*map(F.lit, REFERENCES)), (F.col("page_id") % 7 + 1).cast("int"))
    tokens = ht.html_tokens(text_rows(spark, d, "pages", "page_id").select("page_id", F.concat(F.lit("<p>"), piece, F.lit("</p>")).alias("html")))
    return tokens.where("kind = 'text'").select("page_id", "text")


HIDDEN = "java&#1;script:x", "java&#x0B;script:x", "&#x1F;javascript:x", "javascript&#127;:x", "java&#32;script:x"


@query("h3_hidden_addresses", "SELECT page_id, CAST(1 AS INT) AS pos, 'a' AS tag, 'href' AS name, 'javascript_url' AS reason FROM pages WHERE page_id % 5 < 4")
def h3_hidden(spark, d):
    """Script addresses with references that vanish; a blank inside makes it no script."""
    piece = F.element_at(F.array(*map(F.lit, HIDDEN)), (F.col("page_id") % 5 + 1).cast("int"))
    pages = text_rows(spark, d, "pages", "page_id").select("page_id", F.concat(F.lit("<p><a href=\""), piece, F.lit("\">x</a></p>")).alias("html"))
    return ht.attr_policy(ht.html_tokens(pages)).select("page_id", "pos", "tag", "name", "reason")


@query("h4_tag_balance", f"""
WITH RECURSIVE t AS (SELECT page_id, kind, tag, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM v_html_tokens WHERE kind IN ('start', 'end') AND tag NOT IN ({VOID})),
w AS (SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS st, 0 AS wrong FROM pages
 UNION ALL SELECT w.page_id, t.k, CASE WHEN t.kind = 'start' THEN list_append(st, t.tag) WHEN len(st) > 0 AND st[-1] = t.tag THEN st[1:len(st) - 1] ELSE st END, CASE WHEN t.kind = 'start' OR (len(st) > 0 AND st[-1] = t.tag) THEN wrong ELSE wrong + 1 END
  FROM w JOIN t ON t.page_id = w.page_id AND t.k = w.k + 1)
SELECT page_id, arg_max(wrong, k) AS mismatched, CAST(arg_max(len(st), k) AS INT) AS unclosed, arg_max(wrong, k) = 0 AND arg_max(len(st), k) = 0 AS balanced FROM w GROUP BY 1""")
def h4(spark, d):
    return ht.tag_balance(text_rows(spark, d, "pages", "page_id"))


EDITED = "CASE WHEN page_id % 5 = 0 THEN replace(html, '<nav>', '<nav id=\"n\">') WHEN page_id % 5 = 1 THEN replace(html, '</p>', ' more</p>') WHEN page_id % 5 = 2 THEN replace(html, 'href=\"/', 'href=\"&#47;') WHEN page_id % 5 = 3 THEN replace(html, 'href=\"/', 'href=\"&#x1;/&#11;') ELSE html END"


@query("h5_structural_diff", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM pages WHERE page_id % 11 = 0 OR (page_id % 5 = 0 AND contains(html, '<nav>'))")
def h5(spark, d):
    pages = text_rows(spark, d, "pages", "page_id")
    return ht.structural_diff(pages, pages.where("page_id % 11 <> 0").withColumn("html", F.expr(EDITED)))
