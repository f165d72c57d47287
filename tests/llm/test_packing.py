import numpy as np

from brightloom.llm.packing import Bins, pack


def test_local_search_improves_and_keeps_everything():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5, 0.8, 1500).astype(int), 1, 1000)
    bins = Bins.filled(sizes, 1024)
    before = int((bins.fill > 0).sum())
    squares = int((bins.fill**2).sum())
    bins.improve(1018, 12)
    assert np.array_equal(np.bincount(bins.bin, weights=sizes, minlength=len(bins.fill)).astype(int), bins.fill)
    assert bins.fill.max() <= 1024 and int((bins.fill**2).sum()) > squares
    lower = -(-int(sizes.sum()) // 1024)
    assert lower <= (bins.fill > 0).sum() < before and (bins.fill > 0).sum() <= lower * 1.01 + 1


def test_pack(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 40, 400))] + [(900, "long " * 450), (901, None), (902, ""), (903, "same " * 30), (903, "same " * 30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as row", "2 as block", "3 as id")
    out = pack(df, "doc_id", "text", capacity=100, block_items=64).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 100
    per_doc = out.groupby("doc_id")
    assert set(per_doc.n_pieces.max()[lambda x: x > 1].index) == {900}
    long = out[out.doc_id == 900].sort_values("piece_no")
    assert long.start_token.tolist() == [100 * i for i in range(len(long))] and (long.n_tokens.iloc[:-1] == 100).all()
    assert set(out.doc_id) == {d for d, t in docs if t} and (out.doc_id == 903).sum() == 2
    assert out.container.nunique() <= np.ceil(out.n_tokens.sum() / 100) * 1.05 + 1
    assert pack(df.limit(0), "doc_id", "text").count() == 0
