from scriptorium.llm import bpe
from scriptorium.llm import token_counts as tc


def test_against_brute_force(spark):
    texts = [None, "", "a", "a b", "the the", "w " * 3000, "one two three"] * 3 + ["x1 " * n for n in range(0, 40)]
    df = spark.createDataFrame([(t, 5) for t in texts], "text string, n_tokens int").repartition(5)
    own = bpe.vocabulary(bpe.default_path())
    sizes = [len(own.encode(t)) for t in texts]
    found = tc.answers(tc.histogram(df, "text"))
    rows = {r.n_tokens: r for r in found.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r.n_docs == sizes.count(n)
        assert r.docs_at_least == sum(x >= n for x in sizes) and r.tokens_at_least == sum(x for x in sizes if x >= n)
        assert r.docs_below == sum(x < n for x in sizes) and r.tokens_below == sum(x for x in sizes if x < n)
        assert r.truncated_total == sum(min(x, n) for x in sizes)
        assert abs(r.quantile - sum(x <= n for x in sizes) / len(sizes)) < 1e-12
    for limit in (0, 1, 5, 17, 2999, 10**6):
        r = tc.at_limit(found, limit).first()
        assert (r.docs, r.tokens, r.docs_at_least, r.truncated_total) == (len(sizes), sum(sizes), sum(x >= limit for x in sizes), sum(min(x, limit) for x in sizes))
    assert tc.length_quantile(found, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    empty = tc.answers(tc.histogram(df.limit(0), "text"))
    assert empty.count() == 0 and tc.at_limit(empty, 5).first().truncated_total == 0
