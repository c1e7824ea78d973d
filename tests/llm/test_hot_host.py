"""Common lines of a host with so many texts that a share of them would be far more than 20."""

from skeinframe.llm import line_quality


def test_common_lines_of_a_hot_host(spark):
    own = lambda i, n: " ".join(f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x{chr(97 + k)}" for k in range(n))
    common, rare, copied = (" ".join(f"{x}{chr(97 + k)}" for k in range(16)) for x in ("all", "few", "copy"))
    texts = [f"{common}\n{own(i, 6)}" for i in range(21)] + [f"{rare}\n{own(i, 6)}" for i in range(21, 41)] + [f"{copied}\n{own(41, 6)}"] * 30
    texts += [own(i, 24) for i in range(len(texts), 2600)]
    rows = [(i, x, "hot") for i, x in enumerate(texts)] + [(5000, texts[0], "cold")]
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in line_quality.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (16, False) for i in range(21))
    assert all(got[i] == (0, True) for i in range(21, 41))
    assert all(got[i] == (22, False) for i in range(41, 71))
    assert all(got[i] == (0, True) for i in [*range(71, 2600), 5000])
