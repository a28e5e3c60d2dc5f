"""The corpus pipeline against decisions made document by document."""

import random
import zlib

import numpy as np
from test_llm import brute_components

import corpus_pipeline
from inkmill.llm import langid, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, n int, rejected boolean"
WORDS = {"aa": ["thes", "wher", "ing", "tion", "ough"], "bb": ["quel", "eaux", "ment", "oire", "elle"]}
SLURS = ["grubber", "snotling", "vilebag"]


def fixture(spark, folder):
    """Two languages, toxic texts, copies, near copies, nulls, repeated rows and clashing names."""
    rng = random.Random(8)
    rows, toxic = [], {}
    for i in range(480):
        lang = ("aa", "bb")[i % 2]
        words = [rng.choice(WORDS[lang]) for _ in range(60)]
        if i % 6 == 0:
            for at in rng.sample(range(60), 6):
                words[at] = rng.choice(SLURS)
        rows.append((i, " ".join(words), lang))
        toxic[i] = int(i % 6 == 0)
    clean = [r for r in rows if not toxic[r[0]]]
    rows += [(600 + k, clean[k][1], clean[k][2]) for k in range(10)]
    rows += [(700 + k, clean[20 + k][1] + " end", clean[20 + k][2]) for k in range(10)]
    rows += [clean[3], (800, None, "aa"), (801, "", "aa"), (802, "12 % 34", None), (None, "thes ing tion null", None), (803, "thes ing wher tion ough " * 2000, "aa")]
    docs = spark.createDataFrame([(d, t, lang, None, len(t or ""), 9.0, -1, -1, True) for d, t, lang in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic


def test_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, toxic = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = langid.fit(docs)
    named = [(d, t) for d, t, _ in rows if not model.predict(t)[2]]
    got = corpus_pipeline.language_id(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(named, key=repr)
    assert not {800, 801, 802} & {d for d, _ in named} and len(named) > 480

    judge = toxicity.fit(got, spark.read.parquet(f"{folder}/labels.parquet"))
    features = toxicity.Features(judge.lexicon)
    civil = [(d, t) for d, t in named if judge.scores(features(t)[None, :])[0] < toxicity.THRESHOLD]
    held = [d for d in toxic if zlib.crc32(str(d).encode()) % 3 == 1]
    left = {d for d, _ in civil}
    assert sum(d in left for d in held if toxic[d]) <= 1 and sum(d not in left for d in held if not toxic[d]) <= 2

    once = [(d, t) for d, t in dict(civil).items() if d is not None]
    first = {root for _, _, root in brute_components(once)}
    want = {d: t for d, t in once if d in first}
    want |= {d: t for d, t in civil if d is None}
    assert len(want) <= len(once) - 15

    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert len(pieces.drop_duplicates(["doc_id", "start"])) == len(pieces)
    tokenizer = packing.WordTokenizer(packing.default_tokenizer()).inner
    assert {None if np.isnan(d) else int(d) for d in pieces.doc_id.astype(float)} == set(want)
    for d, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4")
        mine = pieces[pieces.doc_id.isna() if d is None else pieces.doc_id == d].sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
    laid = pieces.sort_values(["sequence_id", "offset"])
    ends = laid.offset + laid.length
    assert (ends.groupby(laid.sequence_id).shift().fillna(0) == laid.offset).all() and ends.max() <= packing.SEQUENCE


def test_stages_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
