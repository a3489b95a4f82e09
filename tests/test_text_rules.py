"""Literal cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from foliolens.functions import text as tx
from foliolens.operators import html as ht
from foliolens.operators import text as ot


def rewrite(spark, text, mode="document"):
    row = ot.rewrite_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), mode).first()
    return row.text, list(row.rules), row.protected


CASES = [
    ("必要なら確認できます。", "確認できます。", ["F1"]),
    ("必要であれば、まとめが可能です。", "まとめが可能です。", ["F2"]),
    ("必要なら送信できます。", "必要なら送信できます。", []),            # unsafe term
    ("必要なら3件を確認できます。", "必要なら3件を確認できます。", []),      # digit
    ("必要なら https://a.b/c を確認できます。", None, []),                    # URL
    ("これは単なる説明ではなく、方針です。", "方針です。", ["C1"]),
    ("説明というより方針です。", "方針です。", ["C2"]),
    ("これは単なる東京都ではなく方針です。", None, []),                       # proper noun
    ("この結果は確認済みは一件。一件だけでは判断できません。詳細は未確認。", "この結果は確認済みは一件。詳細は未確認。", ["E1"]),
    ("一件だけでは判断できません。", None, []),                                # no context
    ("必要なら見直せばできます。" * 3, None, []),                              # third candidate rolls the segment back
    ("```\n必要なら確認できます。\n```\n必要なら確認できます。", "```\n必要なら確認できます。\n```\n確認できます。", ["F1"]),
    ("````\n```\n必要なら確認できます。\n````\n必要なら確認できます。\n", "````\n```\n必要なら確認できます。\n````\n確認できます。\n", ["F1"]),
    ("~~~\n必要なら確認できます。\n", None, []),                               # unclosed fence
    ("| 必要なら確認できます。 |\n> 必要なら確認できます。\n", None, []),
    ("- 必要なら確認できます。", "- 確認できます。", ["F1"]),
    ("", "", []),
]


@pytest.mark.parametrize("text,expected,rules", CASES)
def test_rewrites(spark, text, expected, rules):
    got, found, _ = rewrite(spark, text)
    assert got == (text if expected is None else expected)
    assert found == rules


def test_document_cap_skips_then_fits(spark):
    two, one = "必要なら確認できます。必要なら整理できます。\n", "必要なら確認できます。\n"
    text = two * 3 + one + two + one          # 2+2+2+1, then 2 would pass the cap of 8, 1 still fits
    got, rules, _ = rewrite(spark, text)
    assert len(rules) == 8
    assert got.splitlines()[4] == two.strip() and got.splitlines()[5] == "確認できます。"


def test_response_cap_is_all_or_nothing(spark):
    line = "必要なら確認できます。\n"
    assert rewrite(spark, line * 2, "response")[1] == ["F1", "F1"]
    assert rewrite(spark, line * 3, "response") == (line * 3, [], False)


def test_segments_join_back(spark):
    text = "# 見出し\r\n本文 `code` と [link](x) と /a/b です。\n\n- 1. x 終わり"
    rows = ot.split_segments(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("seg_no").collect()
    assert "".join(r.text for r in rows) == text
    assert [r.text for r in rows if r.protected] == ["# ", "`code`", "[link](x)", "/a/b", "- "]


def test_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\r\nc\r"), (2, ""), (3, "\n"), (4, "x\x0by\x85z")], "doc_id int, text string")
    got = {}
    for r in ot.to_lines(docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {k: (t.splitlines(keepends=True) or [t]) for k, t in [(1, "a\nb\r\nc\r"), (2, ""), (3, "\n"), (4, "x\x0by\x85z")]}


JOINS = [
    ("資料です。", "次の話", "sentence", True), ("項目：", "内容", "symbol-after", True), ("会社は", "成長した会社", "particle-ending", True),
    ("説明", "「引用」", "before-opening", True), ("（", "中", "opening-bracket-end", False), ("文", "、次", "forbidden-line-head", False),
    ("対応", "する予定", "protected-token", False), ("資料", "が届く", "stranded-particle", False), ("走", "りぬけた", "kanji-okurigana", False),
    ("きれ", "いだった", "verb-auxiliary", False), ("ここ", "そこだよ", "contiguous-hiragana", False), ("今日は", "雨", "short-predicate-isolation", False),
    ("・", "項目", "bullet-prefix", False), ("東京", "大阪", "ambiguous-japanese", False), ("12", "34", "protected-token", False),
    ("", "あ", "edge", False), ("a b", "c", "protected-token", False),
]


@pytest.mark.parametrize("left,right,kind,allowed", JOINS)
def test_line_joins(spark, left, right, kind, allowed):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    row = ot.classify_boundary(df, "l", "r").first()
    assert (row.kind, row.allowed) == (kind, allowed)
    single = df.select(tx.classify_join(F.col("l"), F.col("r")).alias("j")).first().j
    assert (single.kind, single.allowed, list(single.rule_ids)) == (row.kind, row.allowed, list(row.rule_ids))


def test_alias_ids(spark):
    df = spark.createDataFrame([("12", "34"), ("wor", "ld"), ("https://a", "b/c"), ("対応", "する"), ("です（注", "意）と"), ("行き", "ました")], "l string, r string")
    got = [list(r[0]) for r in df.select(tx.boundary_aliases(F.col("l"), F.col("r"))).collect()]
    assert got == [["SAFE-WRAP-DIGIT-SPLIT-01"], ["SAFE-WRAP-ENGLISH-SPLIT-01"], ["SAFE-WRAP-URL-SPLIT-01"], ["SAFE-WRAP-NOUN-SURU-SPLIT-01"],
                   ["SAFE-WRAP-BRACKET-PAIR-BOUNDARY-01"], ["SAFE-WRAP-POLITE-FORM-SPLIT-01"]]


def test_break_lint_matches_pairwise_classification(spark):
    segments = ["価格は12", None, "34円です。", None, " 次の（補", None, "足）資料", None, "が"]
    df = spark.createDataFrame([("p", segments)], "paragraph_id string, segments array<string>")
    got = {r.break_index: r.kind for r in ot.break_lint(df).collect()}
    expected = {}
    for i, s in enumerate(segments):
        if s is None:
            left, right = "".join(x for x in segments[:i] if x), "".join(x for x in segments[i + 1:] if x)
            row = ot.classify_boundary(spark.createDataFrame([(left, right)], "l string, r string"), "l", "r").first()
            if not row.allowed:
                expected[i] = row.kind
    assert got == expected and 1 in got


def test_line_lint(spark):
    df = spark.createDataFrame([(1, "は", False), (2, "①", True), (3, "文（", False), (4, "）文", False), (5, "a　b�", False), (6, "ふつう", True)], "id int, text string, bold boolean")
    got = sorted((r.id, r.rule) for r in ot.line_lint(df, ["id"]).collect())
    assert got == [(1, "orphan_particle_or_punctuation"), (2, "circled_number_bold"), (2, "circled_number_separated"), (3, "opening_bracket_at_line_end"),
                   (4, "closing_bracket_at_line_start"), (5, "fullwidth_space"), (5, "replacement_glyph")]


def test_html_fragments(spark):
    pages = spark.createDataFrame([
        (1, '<p>a <b>x</b><br>&amp;</p>'), (2, '<p>a<b>x</p></b>'), (3, '<p>open'), (4, '<script>if (a<b) {"</p>"}</script><p ONCLICK=go title=\'q>"\'>t</p>'),
        (5, '<a href=" JavaScript:x">y</a><!-- <p> --><img src=a.png />')], "page_id int, html string")
    balance = {r.page_id: (r.mismatched, r.unclosed, r.balanced) for r in ht.tag_balance(pages).collect()}
    assert balance == {1: (0, 0, True), 2: (2, 2, False) if balance[2][0] == 2 else (1, 1, False), 3: (0, 1, False), 4: (0, 0, True), 5: (0, 0, True)}
    tokens = ht.html_tokens(pages)
    attrs = {(r.page_id, r.name, r.reason) for r in ht.attr_policy(tokens).collect()}
    assert attrs == {(4, "onclick", "event_handler"), (5, "href", "javascript_url")}
    assert [r.raw for r in tokens.where("page_id = 4 and kind = 'text'").orderBy("pos").collect()] == ['if (a<b) {"</p>"}', "t"]
    assert {(r.page_id, r.reason) for r in ht.tag_policy(tokens).collect()} == {(4, "forbidden")}
    edited = pages.withColumn("html", F.when(F.col("page_id") == 1, F.replace("html", F.lit("a "), F.lit("changed "))).when(
        F.col("page_id") == 5, F.replace("html", F.lit("a.png"), F.lit("b.png"))).otherwise(F.col("html")))
    assert [r.page_id for r in ht.structural_diff(pages, edited).collect()] == [5]
    assert [(r.page_id, r.now_tag) for r in ht.token_diff(tokens, ht.html_tokens(edited)).collect()] == [(5, "img")]


def test_html_references(spark):
    import html
    from foliolens.operators.html import decoded
    texts = ["java&#115;cript:x", "javascript&colon;x", "a=1&amp;b=2", "&#x1F600;&#0;&#xD800;&#99999999;&#", "&notit; &copy &copyx &unknown; & &;", "&NotEqualTilde;", "plain", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decoded(F.col("t")).alias("d")).collect()
    assert [r.d for r in sorted(rows)] == [None if t is None else html.unescape(t) for t in texts]
    pages = spark.createDataFrame([(1, '<a href="java&#115;cript:x()">&lt;x</a>'), (2, '<a href="javascript&colon;x">'), (3, '<p title="a=1&amp;b=2">'), (4, '<p>a</p><script>if (a) "<p>"'),
                                   (5, '<script>x</style><p></script>&amp;')], "page_id int, html string")
    tokens = ht.html_tokens(pages)
    assert {(r.page_id, r.reason) for r in ht.attr_policy(tokens).collect()} == {(1, "javascript_url"), (2, "javascript_url")}
    plain = pages.withColumn("html", F.replace("html", F.lit("&amp;b"), F.lit("&b")))
    assert ht.structural_diff(pages, plain).count() == 0
    kinds = lambda p: [(r.kind, r.tag, r.text) for r in tokens.where(F.col("page_id") == p).orderBy("pos").collect()]
    assert kinds(4) == [("start", "p", None), ("text", "", "a"), ("end", "p", None), ("start", "script", None), ("text", "", 'if (a) "<p>"')]
    assert kinds(5) == [("start", "script", None), ("text", "", "x</style><p>"), ("end", "script", None), ("text", "", "&")]
    assert kinds(1)[1] == ("text", "", "<x")


def test_replay(spark):
    edits = "array<struct<before:string,after:string>>"
    df = spark.createDataFrame([(1, "a b", "a c", [("b", "c")]), (2, "a a", "b a", [("a", "b")]), (3, "x", "y", [("x", "z")]), (4, "x", "x", [])],
                               f"doc_id int, source string, target string, edits {edits}")
    assert [r.outcome for r in ot.replay_edits(df).orderBy("doc_id").collect()] == ["pass", "edit_not_unique", "target_differs", "edit_list_missing"]


def test_sentences_by_cuts_equal_those_by_pattern(spark):
    texts = ["", "a", "。", "a。b", "a。。b", "。a", "a。", "a!?", "あ！い？う．", "a\nb。\nc", "x﷒y。z", "x﷒。。", "﷒", "a!﷒"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", tx.split_sentences(F.col("t"))).withColumn(
        "w", tx.whole_sentences(F.col("t"))).collect()
    for r in rows:
        assert r.w == (r.p if "".join(r.p) == r.t else None), r.t


def test_sentences_of_an_empty_text_and_one_evaluation(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a。b"), (3, None), (4, "。。")], "doc_id int, text string")
    found = ot.sentences(ot.split_segments(docs))
    assert sorted((r.doc_id, r.sent_no, r.sentence) for r in found.collect()) == [(2, 0, "a。"), (2, 1, "b")]
    # the pattern is only for texts that hold the cut, and no filter computes the sentences a second time
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]


def test_lines_by_cuts(spark):
    texts = ["", "\n", "\r", "\r\n", "\r\r\n\n", "a\x0b\x0cb\x1c\x1d\x1ec\x85d e ", "a\rb\r\n\rc", "\n\n\n", "x﷒\ny\r\n", "﷒"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("l", tx.split_lines(F.col("t"))).collect()
    for r in got:
        assert r.l == (r.t.splitlines(keepends=True) or [""]), r.t


def test_rules_look_for_plain_phrases(spark):
    docs = spark.createDataFrame([(1, "必要なら確認できます。a。これは単なる山ではなく川です。 `x` 必要であれば可能です。")], "doc_id int, text string")
    judged = ot.judge_sentences(ot.split_segments(docs))
    found = [(r.result, r.rule) for r in judged.orderBy("seg_no", "sent_no").collect()]
    assert [x for x in found if x[1]] == [("確認できます。", "F1"), ("川です。", "C1")] and (None, None) in found
    assert tx.REWRITE_HINT not in judged._jdf.queryExecution().executedPlan().toString()


def test_breaks_are_judged_once(spark):
    rows = [("p", ["（甲", None, "乙）は\n", None, " の山", None, "https://a", None, "b 1", None, "2する", None, "", None, "　\x85"])]
    found = ot.break_lint(spark.createDataFrame(rows, "paragraph_id string, segments array<string>"))
    assert [(r.break_index, r.rule) for r in found.orderBy("break_index").collect()] == [
        (1, "manual_break_bracket_or_punctuation_split"), (3, "manual_break_particle_split"), (5, "manual_break_inside_japanese_phrase"), (7, "manual_break_word_split"),
        (9, "manual_break_number_split")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "IN (sentence" in x]


def test_strips_by_last_and_first_character(spark):
    texts = ["", " ", "a", "a \n", "\n\x85a b ", "　a　", "a\r\n", "\ta"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip_right(F.col("t")).alias("r"), tx.strip_left(F.col("t")).alias("l")).collect():
        assert (r.r, r.l) == (r.t.rstrip(), r.t.lstrip())
