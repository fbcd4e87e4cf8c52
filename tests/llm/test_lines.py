from vertexloom.llm import lines


def test_repeated_lines(spark, monkeypatch):
    a, b = "one line of more than twelve", "the second  line,\twith blanks "
    docs = [(3, f"{a}\nshort\n{b}"), (1, f"x\n{a}\n"), (2, " the second line, with blanks\nß€😀 only here, and long\n" + a), (4, f"{a}\n{a}"), (5, ""), (6, None), (None, a), (7, "short\nshort")]
    want = {(2, 54, 82, 1, 2), (3, 0, 28, 1, 2), (3, 35, 65, 2, 0), (4, 0, 28, 1, 2), (4, 29, 57, 1, 2)}
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, d1 string")
    for share in (0.001, 0.9):  # all hot; none
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        got = {tuple(r) for r in lines.repeated_lines(df, least=12).collect()}
        assert got == want
    texts = dict(docs)
    assert all(lines.normal(texts[d][s:e]) == lines.normal(texts[f][g:].split("\n")[0]) for d, s, e, f, g in got)
    assert lines.repeated_lines(df.limit(0)).count() == 0
