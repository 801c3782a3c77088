"""Decoding by the id-to-piece join: what it gives for odd ids, and that it moves nothing."""

from ostinata.llm import bpe


def test_decoding_moves_no_token(spark, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_TOKENS", 3, raising=False)
    e = bpe.encoder(bpe.ranks())
    texts = ["", "one", "naïve 日本 😀 words of a longer text", "", "two words"]
    rows = [(i, e.encode_ordinary(t)) for i, t in enumerate(texts)] + [(7, None), (None, e.encode_ordinary("no key")), (1, e.encode_ordinary("again")), (8, [60_000, *e.encode_ordinary("odd"), -1, 50_256])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(2)
    out = bpe.decode(df, "k")
    want = [*enumerate(texts), (7, None), (None, "no key"), (1, "again"), (8, "odd")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    assert out.columns == ["k", "text"] and bpe.decode(df.limit(0), "k").count() == 0
