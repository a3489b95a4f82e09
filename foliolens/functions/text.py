"""Text rules as column expressions: lines, segments, sentences, rewrites, line joins.

A document is one row, so all of this runs inside the row with array functions
and without a shuffle. Java patterns carry ``(?U)`` where the rules are meant
for Unicode digits, letters and spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_of, let, reasons

MAX_REWRITES, MAX_DOCUMENT_REWRITES = 2, 8
OPEN, CLOSE = "\ufdd0", "\ufdd1"  # noncharacters, never part of valid text
CUT = "\ufdd2"  # a third one; texts that hold it are cut by pattern

# ---- fixed values: patterns of the cleanup rules -------------------------------------------
SENTENCE_PROTECTED = (r"(?U)\d|https?://|(?:^|\s)/[\w./~:-]+|(?:^|\s)[A-Za-z]:\\[\\\w. -]+|MEDIA:|`[^`]+`"
                      r"|\b[A-Z][A-Za-z0-9_-]*\b")
UNSAFE_TERMS = ("(?i)承認|許可|権限|認可|停止|安全|再起動|restart|gateway|送信|Slack|Discord|外部|費用|課金|支払|payment"
                "|cost|時刻|時間|手順|依存|authorization|approval")
OFFER_PREFIX = r"(?U)^(必要なら|必要であれば)[、,\s]*"
OFFER_ENDING = r"(?d)(?:できます|可能です|選択肢は.+です)[。．]?$"
UNCERTAINTY = r"(?d)^(.+?)(?:だけでは|のみでは)(?:結論|判断|断定)(?:でき|し)ません[。．]?$"
CONFIRMED = r"(?d)(?:確認済み|確認できた|確認した)(?:は|.{0,60}(?:は|:|：))"
UNRESOLVED = r"(?:未確認|不明|未解決|確認できていない)"
CONTRAST_HEAD = r"(?Ud)^これは単なる([^。．!?！？\n]{1,80})ではなく[、,\s]*([^。．!?！？\n]{1,120}(?:です|ます|でした|ました))[。．]?$"
CONTRAST_RATHER = r"(?Ud)^([^。．!?！？\n]{1,80})というより[、,\s]*([^。．!?！？\n]{1,120}(?:です|ます|でした|ました))[。．]?$"
PROPER_NOUN = r"(?:株式会社|有限会社|合同会社|[都道府県]$|[市区町村]$|大学|病院|銀行)"
INLINE_PROTECTED = (r"(?U)`[^`]*`|!?\[[^\]]*\]\([^)]*\)|https?://[^\s<>()]+"
                    r"|(?:^|(?<=\s))(?:/[\w.~:-]+(?:/[\w.~:-]+)*|[A-Za-z]:\\[^\s<>|]*)|MEDIA:\S*")
INLINE_HINTS = ["`", "[", "/", "\\", "MEDIA:"]  # what stands in every protected span
LINE_PREFIX = r"(?U)^(\s*(?:#{1,6}\s+|(?:[-*+] |\d+[.)] )))"
FENCE = r"(?U)^\s*(`{3,}|~{3,})"
BLOCKQUOTE, PIPE_TABLE, MEDIA_LINE = r"(?U)^\s*>", r"(?Ud)^\s*\|[^\n]*\|\s*$", r"(?U)^\s*MEDIA:"
PROTECTED_LINE = r"(?Ud)^\s*(?:>|MEDIA:|\|[^\n]*\|\s*$)"
SENTENCE = "[^。．!?！？]+[。．!?！？]?"
LINE_END = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
LINE_ENDS, SENTENCE_ENDS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "。．!?！？"
REWRITE_HINT = "必要なら|必要であれば|これは単なる|というより|だけでは|のみでは"
# ---- fixed values: line-join characters and tokens -----------------------------------------
OPENING = "（［【「『〈《〔｛([{<"
FORBIDDEN_HEAD = "）］】」』〉》〕｝)]}>、。，．！？!?：；:;ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ々〻ー〜…‥"
SENTENCE_END = "、。！？!?"
SYMBOL_AFTER = "：:／/・；;"
BULLETS = "・●○■□◆◇▶▷►▸‣⁃-–—※"
BRACKETS = [("（", "）"), ("［", "］"), ("【", "】"), ("「", "」"), ("『", "』"), ("〈", "〉"), ("《", "》"), ("〔", "〕"), ("｛", "｝"),
            ("(", ")"), ("[", "]"), ("{", "}"), ("<", ">")]
PARTICLES = ["ながら", "ので", "から", "より", "まで", "だけ", "しか", "でも", "は", "が", "を", "に", "へ", "と", "や", "も", "の", "で"]
AUXILIARY_HEADS = ["する", "した", "して", "します", "される", "させる", "させられる", "れる", "られる", "ます", "ました", "ません", "です", "でした", "ない", "たい"]
LEFT_SUFFIXES = ["し", "させ", "られ", "れ", "まし", "でし"]
POLITE = (["ます", "ました", "ません", "です", "でした"], ["まし", "でし"])
VERB_AUX = (["れる", "られる", "ない", "たい", "させる", "させられる"], ["し", "させ", "られ", "れ"])
PROTECTED_TOKEN = (r"(?U)https?://[^\s]+"
                   r"|[（［【「『〈《〔｛(\[{<][^）］】」』〉》〕｝)\]}>\r\n]*[）］】」』〉》〕｝)\]}>]"
                   r"|[A-Za-z][A-Za-z0-9._/+:#?=&%-]*"
                   r"|\d+(?:[.,:/-]\d+)*"
                   r"|[一-龯々〆ヵヶァ-ヴー]{1,24}する"
                   r"|[一-龯々]{1,6}[ぁ-ゖ]{1,8}(?:させられる|させる|られる|れる|ました|ません|ます|でした|です|ない|たい)")
KANJI, HIRAGANA, CJK = "[一-龯々〆ヵヶ]", "[ぁ-ゖ]", r"[\u3000-\u9fff\uff00-\uffef]"
RULE_IDS = {
    "edge": "SAFE-WRAP-NATURAL-BREAK-01", "empty": "SAFE-WRAP-NATURAL-BREAK-01",
    "protected-token": "SAFE-WRAP-PROTECTED-TOKEN-01", "opening-bracket-end": "SAFE-WRAP-OPENING-BRACKET-END-01",
    "forbidden-line-head": "SAFE-WRAP-FORBIDDEN-LINE-HEAD-01", "verb-auxiliary": "SAFE-WRAP-FORBIDDEN-PAIR-01",
    "stranded-particle": "SAFE-WRAP-STRANDED-PARTICLE-01", "kanji-okurigana": "SAFE-WRAP-KANJI-OKURIGANA-01",
    "contiguous-hiragana": "SAFE-WRAP-CONTIGUOUS-HIRAGANA-01", "short-predicate-isolation": "SAFE-WRAP-PREDICATE-ISOLATION-01",
    "bullet-prefix": "SAFE-WRAP-BULLET-PREFIX-01", "ambiguous-japanese": "SAFE-WRAP-AMBIGUOUS-JA-BOUNDARY-01",
    "ambiguous": "SAFE-WRAP-NATURAL-BREAK-01",
}
PREFERENCE = {"sentence": 0.0, "symbol-after": 1.0, "space": 2.0, "particle-ending": 4.0, "before-opening": 8.0}
# kinds whose rule id gives way to the more specific alias ids
ALIASED = ["protected-token", "opening-bracket-end", "forbidden-line-head", "verb-auxiliary", "kanji-okurigana",
           "contiguous-hiragana", "ambiguous-japanese", "ambiguous"]


def blank_right(c: Column) -> Column:
    return F.right(c, F.lit(1)).rlike(r"(?U)\s")


def blank_left(c: Column) -> Column:
    return F.left(c, F.lit(1)).rlike(r"(?U)\s")


# a pattern looks at every character, so only texts with a blank at their end are given to it
def strip_right(c: Column) -> Column:
    return F.when(blank_right(c), F.regexp_replace(c, r"(?U)\s+$", "")).otherwise(c)


def strip_left(c: Column) -> Column:
    return F.when(blank_left(c), F.regexp_replace(c, r"(?U)^\s+", "")).otherwise(c)


def strip(c: Column) -> Column:
    return strip_left(strip_right(c))


def line_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(c, r"(?U)\s+", ""), 256)


# ---- lines, fences, segments ---------------------------------------------------------------
def split_lines(text: Column) -> Column:
    """Lines with their ends; an empty text is one line, a final end adds none."""
    parts = F.split(text, LINE_END)
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    marked = F.replace(_marked(text, LINE_ENDS + "\r"), F.lit(f"\r{CUT}\n"), F.lit("\r\n"))
    return F.when(F.contains(text, F.lit(CUT)), parts).otherwise(F.split(F.rtrim(marked, F.lit(CUT)), CUT))


def _marked(text: Column, ends: str) -> Column:
    """The text with a cut behind each of the characters; plain replacements take a small part of the time of a pattern."""
    for c in ends:
        text = F.replace(text, F.lit(c), F.lit(c + CUT))
    return text


def fence_spans(lines: Column) -> Column:
    """(lo, hi) line ranges inside code fences; an unclosed fence runs to the end.

    Only lines that look like a fence enter the ordered fold.
    """
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), F.regexp_extract(x, FENCE, 1).alias("m"),
        (F.length(F.trim(F.regexp_replace(F.regexp_replace(x, FENCE, ""), r"(?U)\s", ""))) == 0).alias("bare"))), lambda s: s["m"] != "")
    state = "struct<lo:int,m:string,spans:array<struct<lo:int,hi:int>>>"
    start = F.struct(F.lit(None).cast("int").alias("lo"), F.lit("").alias("m"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        closes = (F.substring(s["m"], 1, 1) == F.substring(acc["m"], 1, 1)) & (F.length(s["m"]) >= F.length(acc["m"])) & s["bare"]
        opened = F.struct(s["i"].alias("lo"), s["m"].alias("m"), acc["spans"].alias("spans")).cast(state)
        closed = F.struct(F.lit(None).cast("int").alias("lo"), F.lit("").alias("m"), F.concat(
            acc["spans"], F.array(F.struct(acc["lo"].alias("lo"), s["i"].alias("hi")))).alias("spans")).cast(state)
        return F.when(acc["lo"].isNull(), opened).when(closes, closed).otherwise(acc)

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["lo"].alias("lo"), (F.size(lines) - 1).alias("hi")))
        return F.when(acc["lo"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], rest))

    return F.aggregate(marks, start, step, finish)


def _holds(c: Column, parts: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(p)) for p in parts])


def line_kind(line: Column) -> Column:
    return (F.when(line.rlike(BLOCKQUOTE), "blockquote").when(line.rlike(PIPE_TABLE), "pipe_table")
            .when(line.rlike(MEDIA_LINE), "media").otherwise("normal"))


def inline_parts(line: Column) -> Column:
    """Array of (protected, text): list or heading prefix, protected inline spans, prose."""
    kinds = "array<struct<protected:boolean,text:string>>"
    pattern = INLINE_PROTECTED.replace("(?U)", "(?U)(", 1) + ")"

    def with_prefix(prefix: Column) -> Column:
        rest = F.substring(line, F.length(prefix) + 1, F.length(line))
        marked = F.when(_holds(rest, INLINE_HINTS), F.regexp_replace(rest, pattern, f"{OPEN}$1{CLOSE}")).otherwise(rest)
        cut = F.transform(F.split(marked, f"(?={OPEN})|(?<={CLOSE})"), lambda p: F.struct(
            F.startswith(p, F.lit(OPEN)).alias("protected"), F.translate(p, OPEN + CLOSE, "").alias("text")))
        # most lines hold nothing to protect and are one piece
        parts = F.when(_holds(rest, [*INLINE_HINTS, OPEN, CLOSE]), cut).otherwise(F.array(F.struct(F.lit(False).alias("protected"), rest.alias("text"))))
        head = F.when(prefix != "", F.array(F.struct(F.lit(True).alias("protected"), prefix.alias("text")))).otherwise(F.array().cast(kinds))
        both = F.concat(head, F.filter(parts, lambda p: p["text"] != ""))
        whole = F.array(F.struct(F.lit(False).alias("protected"), line.alias("text")))
        return let(both, lambda b: F.when(F.size(b) == 0, whole).otherwise(b))
    return let(F.regexp_extract(line, LINE_PREFIX, 1), with_prefix)


def segments(lines: Column, spans: Column) -> Column:
    """Flat array of (line_no, protected, text) whose texts join back to the document."""
    def with_spans(sp: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            whole = F.exists(sp, lambda s: (s["lo"] <= i) & (i <= s["hi"])) | line.rlike(PROTECTED_LINE)
            alone = F.array(F.struct(i.alias("line_no"), F.lit(True).alias("protected"), line.alias("text")))
            split = F.transform(inline_parts(line), lambda p: F.struct(i.alias("line_no"), p["protected"].alias("protected"), p["text"].alias("text")))
            return F.when(whole, alone).otherwise(split)
        return F.flatten(F.transform(lines, of_line))
    # bound once: an array column used inside a lambda would otherwise be rebuilt per element
    return let(spans, with_spans)


# ---- sentence rules ------------------------------------------------------------------------
def split_sentences(text: Column) -> Column:
    """The sentences of a text, by pattern; end marks at the start or behind another one belong to none."""
    return F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), 1)


def whole_sentences(text: Column) -> Column:
    """The sentences of a text if they join back to it, else null."""
    def by_cuts(parts: Column) -> Column:
        alone = F.arrays_overlap(parts, F.array(*map(F.lit, SENTENCE_ENDS)))
        return F.when(~alone, parts)

    found = split_sentences(text)
    by_pattern = F.when(F.array_join(found, "") == text, found)
    by_mark = let(F.split(F.rtrim(_marked(text, SENTENCE_ENDS), F.lit(CUT)), CUT), by_cuts)
    return (F.when(text == "", F.array().cast("array<string>")).when(F.contains(text, F.lit(CUT)), by_pattern).otherwise(by_mark))


def is_protected(sentence: Column) -> Column:
    return sentence.rlike(SENTENCE_PROTECTED)


def offer_rewrite(s: Column) -> Column:
    """The sentence without its conditional offer, or null."""
    rest = F.regexp_replace(s, OFFER_PREFIX, "")
    return F.when(s.rlike(OFFER_PREFIX) & ~is_protected(s) & ~s.rlike(UNSAFE_TERMS) & rest.rlike(OFFER_ENDING), rest)


def offer_rule(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("必要なら")), "F1").otherwise("F2")


def contrast_rewrite(s: Column) -> Column:
    """(text, rule) keeping the right half of a contrast, or null."""
    def half(pattern: str, rule: str) -> Column:
        left, right = strip(F.regexp_extract(s, pattern, 1)), strip(F.regexp_extract(s, pattern, 2))
        fine = (left != "") & (right != "") & ~left.rlike(PROPER_NOUN) & ~right.rlike(PROPER_NOUN)
        ending = F.when(F.right(s, F.lit(1)).isin("。", "．"), F.right(s, F.lit(1))).otherwise("")
        return F.when(fine, F.struct(F.concat(right, ending).alias("text"), F.lit(rule).alias("rule")))
    return F.when(~is_protected(s), F.when(s.rlike(CONTRAST_HEAD), half(CONTRAST_HEAD, "C1")).when(s.rlike(CONTRAST_RATHER), half(CONTRAST_RATHER, "C2")))


def redundant(s: Column, context: Column) -> Column:
    """An uncertainty sentence already covered by confirmed and unresolved facts next to it."""
    trimmed = strip(s)
    subject = strip(F.regexp_extract(trimmed, UNCERTAINTY, 1))
    return (trimmed.rlike(UNCERTAINTY) & ~is_protected(s) & (subject != "") & F.contains(context, subject)
            & context.rlike(CONFIRMED) & context.rlike(UNRESOLVED))


def sentence_context(sentences: Column, i: Column) -> Column:
    """The up to two sentences before and after position ``i``, joined."""
    start = F.greatest(i - 2, F.lit(0))
    before = F.slice(sentences, start + 1, i - start)
    return F.array_join(F.concat(before, F.slice(sentences, i + 2, F.lit(2))), "")


def sentence_results(text: Column) -> Column:
    """Array of (sentence, result, rule); the first matching rule wins.

    Sentences without any rule phrase skip the rules.
    """
    none = F.lit(None).cast("string")

    def rules(s: Column, i: Column, sents: Column) -> Column:
        offer = F.struct(offer_rewrite(s).alias("text"), offer_rule(s).alias("rule"))

        def after_offer(o: Column) -> Column:
            return F.when(o["text"].isNotNull(), o).otherwise(F.coalesce(
                contrast_rewrite(s), F.when(redundant(s, sentence_context(sents, i)), F.struct(F.lit("").alias("text"), F.lit("E1").alias("rule"))),
                F.struct(none.alias("text"), none.alias("rule"))))
        return let(offer, after_offer)

    def judge(sents: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            found = F.when(_holds(s, REWRITE_HINT.split("|")), rules(s, i, sents))
            return let(found, lambda r: F.struct(s.alias("sentence"), r["text"].alias("result"), r["rule"].alias("rule")))
        return F.transform(sents, one)
    return let(whole_sentences(text), judge)


def prose_result(results: Column, text: Column, limit: int) -> Column:
    """(text, rules, candidates) of one prose segment; over the limit it rolls back."""
    empty = F.array().cast("array<string>")

    def outcome(r: Column) -> Column:
        def with_rules(rules: Column) -> Column:
            n = F.size(rules)
            used = (n > 0) & (n <= limit)
            changed = F.array_join(F.transform(r, lambda x: F.coalesce(x["result"], x["sentence"])), "")
            return F.struct(F.when(used, changed).otherwise(text).alias("text"), F.when(used, rules).otherwise(empty).alias("rules"),
                            F.least(n, F.lit(limit + 1)).alias("candidates"))
        found = F.filter(F.transform(r, lambda x: x["rule"]), lambda x: x.isNotNull())
        return let(F.coalesce(found, empty), with_rules)
    return let(results, outcome)


def accepted_segments(candidates: Column, mode: str, local_limit: int, cap: int) -> Column:
    """Indices of the segments whose rewrite is kept.

    ``response``: all or none, by the total. ``document``: in order; a segment
    that would pass the cap is skipped while later ones may still fit.
    """
    numbered = F.filter(F.transform(candidates, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: s["n"] > 0)
    if mode == "response":
        total = F.aggregate(numbered, F.lit(0), lambda acc, s: acc + s["n"])
        return F.when(total <= cap, F.transform(numbered, lambda s: s["i"])).otherwise(F.array().cast("array<int>"))
    state = "struct<used:int,kept:array<int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        fits = (s["n"] <= local_limit) & (acc["used"] + s["n"] <= cap)
        took = F.struct((acc["used"] + s["n"]).alias("used"), F.concat(acc["kept"], F.array(s["i"])).alias("kept")).cast(state)
        return F.when(fits, took).otherwise(acc)
    return F.aggregate(numbered, start, step, lambda acc: acc["kept"])


# ---- line joins ----------------------------------------------------------------------------
def _chars(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "[]^-\\&" else c for c in characters) + "]"


def _starts(c: Column, tokens: list[str]) -> Column:
    return any_of([F.startswith(c, F.lit(t)) for t in tokens])


def _ends(c: Column, tokens: list[str]) -> Column:
    return any_of([F.endswith(c, F.lit(t)) for t in tokens])


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def only_brackets(c: Column) -> Column:
    return F.regexp_replace(c, "[^" + "".join("\\" + x if x in "[]" else x for pair in BRACKETS for x in pair) + "]++", "")


def boundary_aliases(left: Column, right: Column, trimmed: bool = False, brackets: tuple[Column, Column] | None = None) -> Column:
    """Specific rule ids of a join: digits, words, URLs, noun+suru, polite and verb endings, split brackets."""
    if not trimmed:
        left, right = strip_right(left), strip_left(right)
    last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    both = F.concat(left, right)
    url = F.startswith(both, F.lit("http")) & both.rlike(r"(?U)^https?://[^\s]+$")
    letters = last.rlike("^[A-Za-z]$") & first.rlike("^[A-Za-z]$")
    polite = _starts(right, POLITE[0]) | _ends(left, POLITE[1])
    verb = _starts(right, VERB_AUX[0]) | _ends(left, VERB_AUX[1])
    bl, br = (only_brackets(left), only_brackets(right)) if brackets is None else brackets
    pair = (bl != "") & (br != "") & any_of([(_count(bl, o) > _count(bl, c)) & (_count(br, c) > _count(br, o)) for o, c in BRACKETS])
    found = reasons(
        (last.rlike(r"(?U)^\d$") & first.rlike(r"(?U)^\d$"), "SAFE-WRAP-DIGIT-SPLIT-01"),
        (url, "SAFE-WRAP-URL-SPLIT-01"), (letters & ~url, "SAFE-WRAP-ENGLISH-SPLIT-01"),
        (F.startswith(right, F.lit("する")) & last.rlike("^[一-龯々〆ヵヶァ-ヴー]$"), "SAFE-WRAP-NOUN-SURU-SPLIT-01"),
        (polite, "SAFE-WRAP-POLITE-FORM-SPLIT-01"), (~polite & verb, "SAFE-WRAP-VERB-AUX-SPLIT-01"),
        (pair, "SAFE-WRAP-BRACKET-PAIR-BOUNDARY-01"))
    return F.when((left == "") | (right == ""), F.array().cast("array<string>")).otherwise(found)


def token_spans(text: Column) -> Column:
    """(start, end) of every protected token of a text."""
    marked = F.regexp_replace(text, PROTECTED_TOKEN.replace("(?U)", "(?U)(", 1) + ")", f"{OPEN}$1{CLOSE}")
    kind = "struct<at:int,spans:array<struct<lo:int,hi:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        token = F.startswith(p, F.lit(OPEN))
        end = acc["at"] + F.length(p) - F.when(token, 2).otherwise(0)
        more = F.when(token, F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("lo"), end.alias("hi"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), more.alias("spans")).cast(kind)
    return F.aggregate(F.split(marked, f"(?={OPEN})|(?<={CLOSE})"), start, step, lambda acc: acc["spans"])


def inside_protected(text: Column, index: Column) -> Column:
    """Whether a position lies strictly inside a protected token."""
    marked = F.regexp_replace(text, PROTECTED_TOKEN.replace("(?U)", "(?U)(", 1) + ")", f"{OPEN}$1{CLOSE}")
    pieces = F.split(marked, f"(?={OPEN})|(?<={CLOSE})")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        token = F.startswith(p, F.lit(OPEN))
        end = acc["at"] + F.length(p) - F.when(token, 2).otherwise(0)
        return F.struct(end.alias("at"), (acc["hit"] | (token & (acc["at"] < index) & (index < end))).alias("hit"))
    return F.aggregate(pieces, start, step, lambda acc: acc["hit"])


def boundary_kind(text: Column, index: Column, left: Column | None = None, right: Column | None = None,
                  inside: Column | None = None) -> Column:
    """First matching kind of the ordered decision list for a break before ``index``.

    The trimmed sides and the token test may be passed in when they are columns already.
    """
    left = strip_right(F.left(text, index)) if left is None else left
    right = strip_left(F.substring(text, index + 1, F.length(text))) if right is None else right
    inside = inside_protected(text, index) if inside is None else inside
    last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    particle = _ends(left, PARTICLES)
    around = F.substring(text, index, F.lit(2))
    return (F.when((index <= 0) | (index >= F.length(text)), "edge").when((left == "") | (right == ""), "empty")
            .when(inside, "protected-token").when(last.rlike(_chars(OPENING)), "opening-bracket-end")
            .when(first.rlike(_chars(FORBIDDEN_HEAD)), "forbidden-line-head")
            .when(_starts(right, AUXILIARY_HEADS) | _ends(left, LEFT_SUFFIXES), "verb-auxiliary")
            .when(_starts(right, PARTICLES), "stranded-particle").when(last.rlike(KANJI) & first.rlike(HIRAGANA), "kanji-okurigana")
            .when(last.rlike(HIRAGANA) & first.rlike(HIRAGANA), "contiguous-hiragana")
            .when(particle & (F.length(right) <= 4) & first.rlike(CJK), "short-predicate-isolation")
            .when(last.rlike(_chars(SENTENCE_END)), "sentence")
            .when(last.rlike(_chars(SYMBOL_AFTER)) & (index == 1) & F.left(text, F.lit(1)).rlike(_chars(BULLETS)), "bullet-prefix")
            .when(last.rlike(_chars(SYMBOL_AFTER)), "symbol-after").when(around.rlike(r"(?U)\s"), "space").when(particle, "particle-ending")
            .when(first.rlike(_chars(OPENING)), "before-opening").when(last.rlike(CJK) & first.rlike(CJK), "ambiguous-japanese")
            .otherwise("ambiguous"))


def boundary_details(kind: Column, left: Column, right: Column, trimmed: bool = False,
                     aliases: Column | None = None) -> tuple[Column, Column, Column]:
    """(allowed, rule ids, preference) of a kind at a join of two texts."""
    allowed = kind.isin(list(PREFERENCE))
    table = F.create_map(*[F.lit(x) for kv in RULE_IDS.items() for x in kv])
    aliases = boundary_aliases(left, right) if aliases is None else aliases
    own = F.array(table[kind])
    both = F.when(kind.isin(ALIASED) & (F.size(aliases) > 0), aliases).otherwise(F.array_distinct(F.concat(aliases, own)))
    prefer = F.create_map(*[x for k, v in PREFERENCE.items() for x in (F.lit(k), F.lit(v))])
    # no longer particle ends with this one
    attributive = (kind == "particle-ending") & F.endswith(left if trimmed else strip_right(left), F.lit("の"))
    score = F.when(attributive, F.lit(6.0)).otherwise(F.coalesce(prefer[kind], F.lit(30.0)))
    return allowed, F.when(allowed, F.array().cast("array<string>")).otherwise(both), score


def classify_join(left: Column, right: Column) -> Column:
    """(allowed, kind, rule_ids, preference) for putting two texts on two lines, as one expression."""
    head = strip_right(left)
    text, index = F.concat(head, strip_left(right)), F.length(head)

    def outcome(kind: Column) -> Column:
        allowed, rules, score = boundary_details(kind, left, right)
        return F.struct(allowed.alias("allowed"), kind.alias("kind"), rules.alias("rule_ids"), score.alias("preference"))
    return let(boundary_kind(text, index), outcome)


def with_join(df: DataFrame, left: Column, right: Column, inside: Column | None = None, brackets: tuple[Column, Column] | None = None) -> DataFrame:
    """Add ``allowed, kind, rule_ids, preference`` in stages, so that each text is trimmed once.

    ``inside`` may give the answer of ``inside_protected`` where it is known; null means unknown. ``brackets`` may give
    the brackets of both texts.
    """
    bl, br = brackets or (only_brackets(F.col("_l")), only_brackets(F.col("_r")))
    out = df.withColumn("_l", strip_right(left)).withColumn("_r", strip_left(right))
    out = out.withColumns({"_t": F.concat("_l", "_r"), "_x": F.length("_l"), "_bl": bl, "_br": br})
    own = inside_protected(F.col("_t"), F.col("_x"))
    out = out.withColumn("_in", own if inside is None else F.coalesce(inside, own))
    out = out.withColumn("kind", boundary_kind(F.col("_t"), F.col("_x"), F.col("_l"), F.col("_r"), F.col("_in")))
    out = out.withColumn("_al", boundary_aliases(F.col("_l"), F.col("_r"), True, (F.col("_bl"), F.col("_br"))))
    allowed, rules, score = boundary_details(F.col("kind"), F.col("_l"), F.col("_r"), True, aliases=F.col("_al"))
    return out.withColumns({"allowed": allowed, "rule_ids": rules, "preference": score}).drop("_l", "_r", "_t", "_x", "_in", "_bl", "_br", "_al")


def single_meaning(text: Column) -> Column:
    """One sentence: at most one run of terminal marks, at the end, and no line break."""
    t = strip(text)
    runs = F.regexp_count(t, F.lit("[。！？!?]+"))
    return ~F.contains(t, F.lit("\n")) & ((runs == 0) | ((runs == 1) & t.rlike("[。！？!?]+\\z")))
