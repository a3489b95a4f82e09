"""SQL functions over the same rules, expanded into the plan as expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0D <= 0.04045D THEN {c} / 255.0D / 12.92D ELSE pow(({c} / 255.0D + 0.055D) / 1.055D, 2.4D) END)"


def _any(test: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(test.format(_lit(t)) for t in tokens) + ")"


def _chars(characters: str) -> str:
    return _lit(tx._chars(characters))


def _strip(c: str, side: str) -> str:
    return f"regexp_replace({c}, {_lit(chr(92) + 's+$' if side == 'r' else '^' + chr(92) + 's+').replace(chr(39), chr(39) + '(?U)', 1)}, '')"


def definitions() -> dict[str, str]:
    token = tx.PROTECTED_TOKEN.replace("(?U)", "(?U)(", 1) + ")"
    kinds = f"""CASE WHEN ix <= 0 OR ix >= length(t) THEN 'edge' WHEN hit THEN 'protected-token' WHEN right(l, 1) RLIKE {_chars(tx.OPENING)} THEN 'opening-bracket-end'
      WHEN left(r, 1) RLIKE {_chars(tx.FORBIDDEN_HEAD)} THEN 'forbidden-line-head' WHEN {_any('startswith(r, {})', tx.AUXILIARY_HEADS)} OR {_any('endswith(l, {})', tx.LEFT_SUFFIXES)} THEN 'verb-auxiliary'
      WHEN {_any('startswith(r, {})', tx.PARTICLES)} THEN 'stranded-particle' WHEN right(l, 1) RLIKE {_lit(tx.KANJI)} AND left(r, 1) RLIKE {_lit(tx.HIRAGANA)} THEN 'kanji-okurigana'
      WHEN right(l, 1) RLIKE {_lit(tx.HIRAGANA)} AND left(r, 1) RLIKE {_lit(tx.HIRAGANA)} THEN 'contiguous-hiragana' WHEN {_any('endswith(l, {})', tx.PARTICLES)} AND length(r) <= 4 AND left(r, 1) RLIKE {_lit(tx.CJK)} THEN 'short-predicate-isolation'
      WHEN right(l, 1) RLIKE {_chars(tx.SENTENCE_END)} THEN 'sentence' WHEN right(l, 1) RLIKE {_chars(tx.SYMBOL_AFTER)} AND ix = 1 AND left(t, 1) RLIKE {_chars(tx.BULLETS)} THEN 'bullet-prefix'
      WHEN right(l, 1) RLIKE {_chars(tx.SYMBOL_AFTER)} THEN 'symbol-after' WHEN {_any('endswith(l, {})', tx.PARTICLES)} THEN 'particle-ending' WHEN left(r, 1) RLIKE {_chars(tx.OPENING)} THEN 'before-opening'
      WHEN right(l, 1) RLIKE {_lit(tx.CJK)} AND left(r, 1) RLIKE {_lit(tx.CJK)} THEN 'ambiguous-japanese' ELSE 'ambiguous' END"""
    pieces = f"split(regexp_replace(t, {_lit(token)}, '{tx.OPEN}$1{tx.CLOSE}'), '(?={tx.OPEN})|(?<={tx.CLOSE})')"
    hit = (f"aggregate({pieces}, named_struct('at', 0, 'hit', false), (acc, p) -> named_struct('at', acc.at + length(p) - IF(startswith(p, '{tx.OPEN}'), 2, 0), "
           f"'hit', acc.hit OR (startswith(p, '{tx.OPEN}') AND acc.at < ix AND ix < acc.at + length(p) - 2)), acc -> acc.hit)")
    count = lambda c, x: f"(length({c}) - length(replace({c}, {_lit(x)}, '')))"
    pair = " OR ".join(f"({count('l', o)} > {count('l', c)} AND {count('r', c)} > {count('r', o)})" for o, c in tx.BRACKETS)
    url = "concat(l, r) RLIKE " + _lit(r"(?U)^https?://[^\s]+$")
    polite = f"({_any('startswith(r, {})', tx.POLITE[0])} OR {_any('endswith(l, {})', tx.POLITE[1])})"
    verb = f"({_any('startswith(r, {})', tx.VERB_AUX[0])} OR {_any('endswith(l, {})', tx.VERB_AUX[1])})"
    last, first = "right(l, 1) RLIKE ", "left(r, 1) RLIKE "
    aliases = ", ".join(f"CASE WHEN {cond} THEN 'SAFE-WRAP-{name}-01' END" for cond, name in (
        (last + _lit(r"(?U)^\d$") + " AND " + first + _lit(r"(?U)^\d$"), "DIGIT-SPLIT"), (url, "URL-SPLIT"),
        (last + _lit("^[A-Za-z]$") + " AND " + first + _lit("^[A-Za-z]$") + f" AND NOT {url}", "ENGLISH-SPLIT"),
        ("startswith(r, 'する') AND " + last + _lit("^[一-龯々〆ヵヶァ-ヴー]$"), "NOUN-SURU-SPLIT"), (polite, "POLITE-FORM-SPLIT"), (f"NOT {polite} AND {verb}", "VERB-AUX-SPLIT"), (f"({pair})", "BRACKET-PAIR-BOUNDARY")))
    lum = "0.2126D * {0} + 0.7152D * {1} + 0.0722D * {2}"
    gap = ("least(x0 * dx + y0 * dy, x0 * dx + y1 * dy, x1 * dx + y0 * dy, x1 * dx + y1 * dy) / sqrt(dx * dx + dy * dy) - (ax * dx + ay * dy) / sqrt(dx * dx + dy * dy)")
    box = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
    return {
        "color_luminance(r INT, g INT, b INT) RETURNS DOUBLE": lum.format(_linear("r"), _linear("g"), _linear("b")),
        "color_contrast(r1 INT, g1 INT, b1 INT, r2 INT, g2 INT, b2 INT) RETURNS DOUBLE":
            "(greatest(color_luminance(r1, g1, b1), color_luminance(r2, g2, b2)) + 0.05D) / (least(color_luminance(r1, g1, b1), color_luminance(r2, g2, b2)) + 0.05D)",
        "color_mode(r INT, g INT, b INT) RETURNS STRING":
            "CASE WHEN color_luminance(r, g, b) <= 0.10D THEN 'near-black' WHEN color_luminance(r, g, b) >= 0.90D THEN 'near-white' ELSE 'other' END",
        "hex_to_rgb(h STRING) RETURNS STRUCT<r INT, g INT, b INT>":
            "CASE WHEN h RLIKE '^#[0-9A-Fa-f]{6}$' THEN named_struct('r', CAST(conv(substring(h, 2, 2), 16, 10) AS INT), 'g', CAST(conv(substring(h, 4, 2), 16, 10) AS INT), 'b', CAST(conv(substring(h, 6, 2), 16, 10) AS INT)) END",
        "rgb_to_hex(r INT, g INT, b INT) RETURNS STRING":
            "CASE WHEN r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 THEN concat('#', lpad(hex(r), 2, '0'), lpad(hex(g), 2, '0'), lpad(hex(b), 2, '0')) END",
        "single_meaning(t STRING) RETURNS BOOLEAN":
            "NOT contains(regexp_replace(t, '(?U)^\\\\s+|\\\\s+$', ''), '\\n') AND (regexp_count(t, '[。！？!?]+') = 0 OR (regexp_count(t, '[。！？!?]+') = 1 AND t RLIKE '(?U)[。！？!?]+\\\\s*\\\\z'))",
        "label_tier(choice STRING, confidence DOUBLE, breakage DOUBLE, unnatural DOUBLE) RETURNS STRING":
            "CASE WHEN (choice = 'repair_required' AND coalesce(confidence, 0D) >= 0.5D) OR coalesce(breakage, 0D) >= 0.5D THEN 'repair_required' WHEN choice = 'repair_required' OR coalesce(unnatural, 0D) >= 0.5D THEN 'differs_from_surroundings' "
            "WHEN choice IN ('intended', 'acceptable', 'insufficient_information') THEN choice ELSE 'insufficient_information' END",
        f"anchor_gap(ax DOUBLE, ay DOUBLE, dx DOUBLE, dy DOUBLE, {box}) RETURNS DOUBLE": gap,
        f"anchor_shift(ax DOUBLE, ay DOUBLE, dx DOUBLE, dy DOUBLE, {box}, target DOUBLE) RETURNS STRUCT<dx DOUBLE, dy DOUBLE>":
            "named_struct('dx', (target * (x1 - x0) - anchor_gap(ax, ay, dx, dy, x0, y0, x1, y1)) * dx / sqrt(dx * dx + dy * dy), 'dy', (target * (x1 - x0) - anchor_gap(ax, ay, dx, dy, x0, y0, x1, y1)) * dy / sqrt(dx * dx + dy * dy))",
        "frame_gap(rel STRING, gx0 DOUBLE, gy0 DOUBLE, gx1 DOUBLE, gy1 DOUBLE, tx0 DOUBLE, ty0 DOUBLE, tx1 DOUBLE, ty1 DOUBLE) RETURNS DOUBLE":
            "CASE WHEN rel = 'inside' THEN least(gx0 - tx0, gy0 - ty0, tx1 - gx1, ty1 - gy1) WHEN greatest(0D, least(gx1, tx1) - greatest(gx0, tx0)) * greatest(0D, least(gy1, ty1) - greatest(gy0, ty0)) = 0 "
            "THEN sqrt(pow(greatest(tx0 - gx1, gx0 - tx1, 0D), 2) + pow(greatest(ty0 - gy1, gy0 - ty1, 0D), 2)) ELSE -least(least(gx1, tx1) - greatest(gx0, tx0), least(gy1, ty1) - greatest(gy0, ty0)) END",
        "center_delta(g0 DOUBLE, g1 DOUBLE, f0 DOUBLE, f1 DOUBLE, pad0 DOUBLE, pad1 DOUBLE) RETURNS DOUBLE": "(g0 + g1 - (f0 + pad0) - (f1 - pad1)) / 2",
        "_join_kind(t STRING, ix INT, l STRING, r STRING, hit BOOLEAN) RETURNS STRING": kinds,
        "_inside_token(t STRING, ix INT) RETURNS BOOLEAN": hit,
        "_join_trimmed(l STRING, r STRING) RETURNS STRING": "_join_kind(concat(l, r), length(l), l, r, _inside_token(concat(l, r), length(l)))",
        "line_join_kind(a STRING, b STRING) RETURNS STRING": f"_join_trimmed({_strip('a', 'r')}, {_strip('b', 'l')})",
        "_aliases(l STRING, r STRING) RETURNS ARRAY<STRING>": f"IF(l = '' OR r = '', CAST(array() AS ARRAY<STRING>), array_compact(array({aliases})))",
        "line_join_aliases(a STRING, b STRING) RETURNS ARRAY<STRING>": f"_aliases({_strip('a', 'r')}, {_strip('b', 'l')})",
        "line_join_allowed(a STRING, b STRING) RETURNS BOOLEAN": "line_join_kind(a, b) IN (" + ", ".join(f"'{k}'" for k in tx.PREFERENCE) + ")",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions in a session; returns their names."""
    names = []
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    return names
