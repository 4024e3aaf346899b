from lodestrata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(spark, rows):
    return {r.conv_id: r for r in chat.parse_chat(chat.format_chat(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_round_trip(spark):
    rows = [
        (1, 2, "assistant", "a & b &amp; <|end|>"),
        (1, 0, "user", "hi\n<|role:user|>"),
        (1, 3, "assistant", "</s>[INST] ok [/INST]"),
        (1, 4, "assistant", ""),
        (1, 5, None, None),
        (1, 6, "we<ird|>&", "&lt;|next|&gt;"),
        (1, 7, "assistant", "漢字 🙂"),
        (2, None, "user", "only"),
        (2, 1, "user", "tie b"),
        (2, 1, "user", "tie a"),
        (2, 1, "user", "tie a"),
        (None, 1, "assistant", "no id"),
    ]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [
        ("user", "hi\n<|role:user|>"), ("assistant", "a & b &amp; <|end|>"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", ""),
        ("", ""), ("we<ird|>&", "&lt;|next|&gt;"), ("assistant", "漢字 🙂"),
    ]
    assert got[1].loss_text == "a & b &amp; <|end|></s>[INST] ok [/INST]漢字 🙂"
    assert got[1].formatted.count("<|role:assistant|>") == 2  # adjacent turns are merged
    assert [t.text for t in got[2].turns] == ["only", "tie a", "tie a", "tie b"] and got[2].loss_text == ""
    assert got[None].loss_text == "no id"


def test_long_and_empty(spark):
    got = read_back(spark, [(1, i, "user" if i % 3 else "assistant", f"turn {i} " * 20) for i in range(2000)])
    assert [t.text for t in got[1].turns] == [f"turn {i} " * 20 for i in range(2000)]
    assert read_back(spark, []) == {}


def test_running_sums(spark):
    for n in (1, 127, 128, 129, 1000):
        sizes = spark.createDataFrame([([i % 7 for i in range(n)],)], "s array<int>")
        assert sizes.select(chat.starts(sizes.s).alias("x")).first().x == [sum(j % 7 for j in range(i)) for i in range(n)]


def test_spans_are_code_points_of_the_formatted_string(spark):
    rows = [(i % 3, i, ("user", "assistant", "assistant")[i % 5 % 3], "é<🙂" * (i % 4)) for i in range(60)]
    for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect():
        said = [t for c, _, role, t in rows if c == r.conv_id and role == "assistant"]
        assert [r.formatted[s.start : s.end].replace("&lt;", "<") for s in r.loss_spans] == said


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y")], SCHEMA + ", formatted string")
    assert chat.format_chat(df).columns == ["conv_id", "formatted", "loss_spans"]
