"""HTML token operators over raw pages. A page is one row; tokens are made within it."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: tag lists of the fragment policy
FORBIDDEN_TAGS = ["html", "head", "body", "script", "style", "iframe", "object", "embed", "form", "input", "button", "select", "textarea",
                  "video", "audio", "canvas", "svg"]
ALLOWED_TAGS = ["p", "h2", "h3", "h4", "h5", "h6", "figure", "img", "a", "strong", "em", "b", "i", "ul", "ol", "li", "blockquote", "br", "hr",
                "span", "div", "table", "thead", "tbody", "tr", "th", "td", "caption", "code", "pre", "small", "sup", "sub"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
INSIDE = r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+"
# script and style run to their own end tag, or to the end of the page where it is missing
RAW = rf"<(script|style)\b{INSIDE}>(?:[\s\S]*?</\2\s*>|[\s\S]*\z)"
TOKEN = rf"(?i)(<!--[\s\S]*?-->|<![^>]*>|<\?[^>]*>|{RAW}|</?[a-z]{INSIDE}>|(?>[^<]+|<(?![a-z/!?]))++|<)"
ATTRIBUTE = r"([^\s=>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)"
TOKEN_TYPE = "struct<kind:string,tag:string,raw:string,body:boolean>"  # body: inside of a script or style
REFERENCE = r"(&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&)"


def decoded(text: Column) -> Column:
    """Text with its character references replaced: numbers, names of the standard table, and old names without semicolon.

    Numbers follow the rules of HTML: 0x80 to 0x9F are read in code page 1252, control characters and noncharacters vanish,
    0, surrogates and what is above U+10FFFF become U+FFFD. An unknown name stays as it is.
    """
    western = F.array(*[F.lit(ord(bytes([c]).decode("cp1252", "replace").replace("\ufffd", chr(c)))) for c in range(0x80, 0xA0)])
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")

    def number(piece: Column) -> Column:
        hexed = piece.rlike("^&#[xX]")
        digits = F.regexp_replace(F.regexp_extract(piece, "^&#[xX]?([0-9A-Fa-f]+)", 1), "^0+(?=.)", "")
        point = F.when(F.length(digits) > 7, F.lit(1 << 24)).otherwise(F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        bad = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
        gone = point.between(0x1, 0x8) | (point == 0xB) | point.between(0xE, 0x1F) | (point == 0x7F) | point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(0xFFFE) == 0xFFFE)
        known = F.when(bad, F.lit(0xFFFD)).when(point.between(0x80, 0x9F), F.try_element_at(western, (point - 0x7F).cast("int"))).otherwise(point)
        return F.when(gone & ~bad, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32"))

    def name(piece: Column) -> Column:
        word = F.substring(piece, F.lit(2), F.length(piece))
        ends = F.filter(F.sequence(F.lit(1), F.length(word)), lambda k: F.map_contains_key(names, F.substring(word, F.lit(1), k)))
        prefix = F.array_max(ends)
        cut = F.concat(F.try_element_at(names, F.substring(word, F.lit(1), prefix)), F.substring(word, prefix + 1, F.length(word)))
        return F.coalesce(F.try_element_at(names, word), cut, piece)

    def piece(p: Column) -> Column:
        return F.when(p.rlike("^&#[xX]?[0-9A-Fa-f]"), number(p)).when(p.rlike("^&[A-Za-z]"), name(p)).otherwise(p)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), piece), "")).otherwise(text)


def _kind(raw: Column) -> Column:
    return (F.when(F.startswith(raw, F.lit("<!--")), "comment").when(F.startswith(raw, F.lit("<!")), "decl").when(F.startswith(raw, F.lit("<?")), "pi")
            .when(raw.rlike("^</[A-Za-z]"), "end").when(raw.rlike(r"^<[A-Za-z][\s\S]*/>\z"), "void").when(raw.rlike(r"^<[A-Za-z]"), "start").otherwise("text"))


def _token(raw: Column) -> Column:
    return F.struct(_kind(raw).alias("kind"), F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][^\s/>]*)", 1)).alias("tag"), raw.alias("raw"), F.lit(False).alias("body")).cast(TOKEN_TYPE)


def tokens_of(html: Column) -> Column:
    """Array of (kind, tag, raw) in page order; script and style bodies are one text token."""
    def expand(raw: Column) -> Column:
        head = F.regexp_extract(raw, rf"^(<[A-Za-z]{INSIDE}>)", 1)
        tail = F.regexp_extract(raw, r"(?i)^<(script|style)\b[\s\S]*(</\1\s*>)\z", 2)
        body = F.substring(raw, F.length(head) + 1, F.length(raw) - F.length(head) - F.length(tail))
        three = F.array(_token(head), F.struct(F.lit("text").alias("kind"), F.lit("").alias("tag"), body.alias("raw"), F.lit(True).alias("body")).cast(TOKEN_TYPE), _token(tail))
        is_raw = raw.rlike(rf"(?i)^<(?:script|style)\b{INSIDE}>")
        return F.when(is_raw, F.filter(three, lambda t: t["raw"] != "")).otherwise(F.array(_token(raw)))
    return F.filter(F.flatten(F.transform(F.regexp_extract_all(html, F.lit(TOKEN), 1), expand)), lambda t: t["kind"] != "pi")


def attributes_of(raw: Column) -> Column:
    """Sorted array of (name, value) of a start tag, references decoded; a missing value is empty."""
    inside = F.regexp_extract(raw, r"^<[A-Za-z][^\s/>]*([\s\S]*?)/?>\z", 1)
    pairs = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), lambda a: F.struct(
        F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"),
        decoded(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, r"=\s*([\s\S]*)\z", 1), "^[\"']", ""), "[\"']\\z", "")).alias("value")))
    return F.array_sort(pairs)


def html_tokens(pages: DataFrame) -> DataFrame:
    """Tokens in page order with attributes and, for text tokens, the text with its references decoded."""
    return pages.select("page_id", F.posexplode_outer(tokens_of(F.col("html"))).alias("pos", "t")).select(
        "page_id", "pos", F.col("t.kind").alias("kind"), F.col("t.tag").alias("tag"),
        F.when(F.col("t.kind").isin("start", "void"), attributes_of(F.col("t.raw"))).alias("attrs"), F.col("t.raw").alias("raw"),
        F.when(F.col("t.kind") == "text", F.when(F.col("t.body"), F.col("t.raw")).otherwise(decoded(F.col("t.raw")))).alias("text"))


def tag_policy(tokens: DataFrame) -> DataFrame:
    """Forbidden and unsupported tags, and declarations."""
    opened = F.col("kind").isin("start", "void")
    reason = (F.when(opened & F.col("tag").isin(FORBIDDEN_TAGS), "forbidden").when(opened & ~F.col("tag").isin(ALLOWED_TAGS), "unsupported")
              .when(F.col("kind") == "decl", "declaration"))
    return tokens.select("page_id", "pos", "tag", reason.alias("reason")).where(F.col("reason").isNotNull())


def attr_policy(tokens: DataFrame) -> DataFrame:
    """Event handlers and script URLs in attributes."""
    attr = tokens.where(F.col("attrs").isNotNull()).select("page_id", "pos", "tag", F.explode("attrs").alias("a"))
    script = F.col("a.name").isin("href", "src", "srcset", "action", "poster") & F.startswith(F.lower(F.trim(F.col("a.value"))), F.lit("javascript:"))
    reason = F.when(F.startswith(F.col("a.name"), F.lit("on")), "event_handler").when(script, "javascript_url")
    return attr.select("page_id", "pos", "tag", F.col("a.name").alias("name"), reason.alias("reason")).where(F.col("reason").isNotNull())


def tag_balance(pages: DataFrame) -> DataFrame:
    """Whether the tags of a page nest and close; void tags do not count."""
    tags = F.filter(tokens_of(F.col("html")), lambda t: t["kind"].isin("start", "end") & ~t["tag"].isin(VOID_TAGS))
    state = "struct<stack:array<string>,wrong:int>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("wrong")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        stack = acc["stack"]
        push = F.struct(F.concat(stack, F.array(t["tag"])).alias("stack"), acc["wrong"].alias("wrong")).cast(state)
        matches = (F.size(stack) > 0) & (F.element_at(stack, -1) == t["tag"])
        pop = F.struct(F.slice(stack, F.lit(1), F.size(stack) - 1).alias("stack"), acc["wrong"].alias("wrong")).cast(state)
        bad = F.struct(stack.alias("stack"), (acc["wrong"] + 1).alias("wrong")).cast(state)
        return F.when(t["kind"] == "start", push).when(F.coalesce(matches, F.lit(False)), pop).otherwise(bad)

    return pages.select("page_id", F.aggregate(tags, start, step).alias("s")).select(
        "page_id", F.col("s.wrong").alias("mismatched"), F.size("s.stack").alias("unclosed"),
        ((F.col("s.wrong") == 0) & (F.size("s.stack") == 0)).alias("balanced"))


def structure_hash(html: Column) -> Column:
    """Digest of a page's tokens without its texts."""
    def shape(t: Column) -> Column:
        attrs = F.array_join(F.transform(attributes_of(t["raw"]), lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
        return F.concat_ws("|", t["kind"], t["tag"], F.when(t["kind"].isin("start", "void"), attrs).when(t["kind"] != "end", t["raw"]).otherwise(""))
    return F.sha2(F.array_join(F.transform(F.filter(tokens_of(html), lambda t: t["kind"] != "text"), shape), "\n"), 256)


def structural_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages whose markup differs between two versions, texts aside."""
    a = before.select("page_id", structure_hash(F.col("html")).alias("was"))
    b = after.select("page_id", structure_hash(F.col("html")).alias("now"))
    return a.join(b, "page_id", "full_outer").select("page_id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(
        F.col("was") != F.col("now"), "changed").alias("change")).where(F.col("change").isNotNull())


def token_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Markup tokens that differ by position. Both are ``html_tokens`` tables."""
    def numbered(df: DataFrame, n: str) -> DataFrame:
        from ..functions import skew
        kept = df.where(F.col("kind") != "text")
        ranked = skew.number_rows(kept, ["page_id"], ["pos"], F.floor(F.col("pos") / 4096), "rank")
        return ranked.select("page_id", "rank", F.struct("kind", "tag", "attrs").alias(n))
    both = numbered(before, "was").join(numbered(after, "now"), ["page_id", "rank"], "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(
        "page_id", "rank", F.col("was.tag").alias("was_tag"), F.col("now.tag").alias("now_tag"))
