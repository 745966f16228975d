"""The scan on the facts known of it: phrases, names, rules, numbers, ranges."""

import pytest

from phrasewright.functions import normal, numbers
from phrasewright.operators import rules as R
from phrasewright.operators import scan as S

READINGS = dict(他="tha", 很="ngận", 好="hảo", 红="hồng", 中="trung", 人="nhân", 甲="giáp", 乙="ất", 丙="bính", 丁="đinh", 在="tại", 身="thân", 后="hậu", 张="trương", 先="tiên", 生="sinh", 厉="lệ", 害="hại", 一="nhất")
RULES = [("在{n}身后", "sau lưng {n}"), ("{s}年{s}月{s}号", "ngày {3} tháng {2} năm {1}"), ("{s}分之{s}", "{2}/{1}"), ("百分[之]?{s}", "{s}%"), ("第{s}(更|章)", "chương {s}:"), ("{s}两", "{s} lượng"), ("{s}多人", "hơn {s} người")]


@pytest.fixture(scope="module")
def prepared(spark):
    return [r.asDict() for r in R.prepared(spark.createDataFrame(RULES, "key string, value string")).collect()]


def run(text, options=S.Options(), mode="phrases", **tables):
    lex, x = S.Lexicon.of(**{"readings": READINGS, **tables}), normal.Aligned(text)
    said, source, target = S.read_aloud(x, lex.readings) if mode == "readings" else S.scan(x, lex, options)
    return said, list(zip(*source, strict=True)), list(zip(*target, strict=True))


def test_phrases_and_readings():
    phrases = {"很好": "rất tốt/rất ổn", "红中人": "cả cụm", "甲乙": "A", "乙丙丁": "B"}
    assert run("他很好", phrases=phrases)[0] == " tha rất tốt/rất ổn"
    assert run("很好", S.Options(wrap=True), phrases={"很好": "rất tốt"})[0] == " [rất tốt]"
    assert run("甲乙丙丁", S.Options(algorithm=0), phrases=phrases)[0] == " giáp B"
    assert run("甲乙丙丁", phrases=phrases)[0] == " A bính đinh"
    named = {"phrases": phrases | {"中人": "trung nhân"}, "names": {"中人": "trung nhân"}}
    assert run("红中人", **named)[0] == " hồng trung nhân"
    assert run("红中人", S.Options(names_first=False), **named)[0] == " cả cụm"
    assert run("", phrases=phrases) == ("", [], [])
    assert run("他, 他. 他")[0] == " tha, tha. Tha"
    assert run("他很厉害", mode="readings")[0] == " tha ngận lệ hại"
    assert run("他, 好", mode="readings", readings={"他": "tha"})[0] == " tha, 好"


def test_ranges():
    assert run("😀") == ("😀", [(0, 2)], [(0, 2)])
    text, source, target = run("😀一", mode="readings")
    assert text == "😀 nhất" and source == [(0, 2), (2, 1)] and target[1] == (2, 4)
    assert run("一百二十三") == (" 123", [(0, 5)], [(1, 3)])
    assert run("三四万") == (" 3-4 vạn", [(0, 3)], [(1, 7)])


def test_numbers():
    cases = {"三四万": "3-4 vạn", "三四千万": "3000-4000 vạn", "十一二万": "11 vạn-12 vạn", "三万四五": "3 vạn 4,000-3 vạn 5,000", "二十三四": "23-24", "一二": "1-2", "001": "001", "1.25": "1.25", "一百二十三": "123", "四三万": "43 vạn" and numbers.phrase("四三万")}
    for text, said in cases.items():
        assert numbers.phrase(text) == said, text
    assert numbers.magnitude(123456789) == "1 ức 2,345 vạn 6,789" and numbers.magnitude(10**12) == "1 vạn ức"
    assert numbers.spans("一二三", {"一二三"}) == {1: (2, "二三")}
    assert numbers.spans("百 12 三") == {0: (6, "百一二三")} and numbers.spans("万") == {}


def test_rules(prepared):
    rules = R.Rules.of(prepared, nouns={"他": "hắn"})
    for text, said in {"第十二章": "chương 12:", "百分之三点五": "3.5%", "三分之四": "4/3", "2025年7月21号": "ngày 21 tháng 7 năm 2025", "在他身后": "sau lưng hắn", "2025年7月2号": "mùng 2 tháng 7 năm 2025", "十两": "10 lượng"}.items():
        m = rules.best(text)
        assert m.index == 0 and rules.render(text, m) == said, text
    m = rules.best("在X身后在他身后")
    assert (m.index, m.length, m.noun) == (4, 4, "hắn")
    for key, begin in {"在{n}身后": "在", "第{s}(更|章)": "第", "百分[之]?{s}": "百分", "QQ号{n}": "QQ号", "{s}年{s}月{s}号": "", "[与和跟]{n}无关": "", "在?他{n}": "", "很{2}好{n}": "", "他|她{n}身后": "", "在 他{n}": "在"}.items():
        assert R.anchor(key) == begin, key
    assert R.literals("在{n}身[后]?x?y(a|b)") == ["在", "身", "y"] and R.measure("(更|章节)[ab]c?") == 3 and R.needed("在{n}身后来[的]?") == "身后来"


def test_rules_in_the_scan(prepared):
    phrases, nouns = {"很好": "rất tốt"}, {"他": "hắn"}
    assert run("在他身后很好", phrases=phrases, nouns=nouns, rules=prepared)[0] == " sau lưng hắn rất tốt"
    assert run("2025年7月21号", rules=prepared)[0] == " ngày 21 tháng 7 năm 2025"
    assert run("张先生", surnames={"张": "Trương"}, suffixes={"先生": "tiên sinh"})[0] == " Trương tiên sinh"
    assert run("一百二十三", phrases={"一百二十三": "một trăm hai mươi ba"}, raw={"一百二十三": "x"})[0] == " một trăm hai mươi ba"


def test_bad_rule(spark):
    with pytest.raises(ValueError, match="invalid rule"):
        R.prepared(spark.createDataFrame([("([{n}", "x")], "key string, value string"))


def test_lexicon_layers(spark):
    rows = [("vietphrase", 0, "萧炎", "Fixed"), ("vietphrase", 1, "很好", "rất tốt"), ("names", 0, "萧炎", "First"), ("names2", 0, "萧炎", "Second/Other"), ("pronouns", 0, "他", "hắn"), ("readings", 0, "他", "tha"), ("readings", 1, "很", "ngận"), ("vietphrase", 2, "字" * 16, "LONG"), ("rules", 0, "在{n}身后", "sau lưng {n}")]
    schema = "dict string, line_no int, key string, value string"
    pairs = spark.createDataFrame(rows, schema)
    texts = spark.createDataFrame([(1, "萧炎"), (2, "他很好"), (3, None)], "doc_id long, text string")
    said = lambda lex: {r.doc_id: r.translated for r in S.translated(texts, lex).collect()}
    assert said(S.lexicon(pairs, one_meaning=True)) == {1: " Second", 2: " tha rất tốt", 3: ""}
    assert said(S.lexicon(pairs, {"names2": pairs.limit(0)}))[1] == " First"
    assert said(S.lexicon(pairs, {"names2": pairs.limit(0), "names": pairs.limit(0)}))[1] == " Fixed"
    patch = spark.createDataFrame([("p", 0, "很好", "rất ổn"), ("p", 1, "萧炎", "no")], schema), spark.createDataFrame([("p", 0, "他", "hắn")], schema)
    assert said(S.lexicon(pairs, None, {"vietphrase": patch[0], "readings": patch[1]})) == {1: " Second/Other", 2: " hắn rất ổn", 3: ""}


def test_normaliser():
    table, known, ignored = normal.tables(("這書後", "这书后"), READINGS | {"这": "", "是": "", "本": "", "书": "", "等": ""}, ["这是一本书"])
    got = normal.standardize("這是一本書。 他&amp;他 ＡＢＣ１２３ 等等……", table, known)
    assert got.text == "这是一本书. 他 & 他 ABC123 等等..."
    assert normal.standardize("😀……", table, known).ranges[2] == (2, 2) or normal.standardize("😀……", table, known).text.startswith("😀")
    assert normal.standardize("這是一本書他", table, known, ignored).text.strip() == "他"
    text, blocked = normal.blanked("😀這是一本書好", table, known, ignored)
    assert text == "😀\n\n\n\n\n好" and blocked == [False, *[True] * 5, False]
    assert normal._ENTITY.sub(lambda m: normal.entity(m) or m[0], "&a &lt;&#65;&#x42;&nope;&#xD800;") == "&a <AB&nope;&#xD800;"
