import hashlib
import io
import json
import random
import re
import wave
import zlib
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from inkmill.llm import chat, jaccard, langid, media, packing, quality, sentencepieces, sharding, shingles, toxicity, urls

EDGE = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, "one two"), (5, "ONE two"), (6, "x " * 30_000), (7, " \n\t")]


def edge(spark, rows=EDGE):
    """Repeated rows, nulls, empty and long texts, and columns whose names clash with results."""
    return spark.createDataFrame([(a, b, 1, "z", 2.0) for a, b in rows], "doc_id long, text string, n int, kept string, score double")


def collect(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_empty_tables(spark):
    none = edge(spark, [])
    docs = none.selectExpr("doc_id", "text", "'en' as lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = packing.default_tokenizer()
    for df in (
        sentencepieces.encode(none, sentencepieces.default_model()), sharding.shard(none), packing.pack(none, path), quality.quality_rules(none), jaccard.jaccard_components(none),
        toxicity.score(docs, toxicity.fit(docs, labels)), media.media_columns(none), langid.identify(docs), chat.format_chat(spark.createDataFrame([], "conv_id long, turn int, role string, text string")),
        urls.judge_urls(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert df.count() == 0


def test_sentencepiece_against_the_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = sentencepieces.default_model()
    mine, theirs = sentencepieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng, pool = random.Random(5), "  abcdefghijthe in on \n\t.,!?éèß中文😀İ▁<0x0A>𐍈1234567890"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        assert mine.encode(t) == theirs.encode(t)
        assert mine.decode(mine.encode(t)) == theirs.decode(theirs.encode(t))
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -max(1.0, -p.score) ** 0.5
    uni, lib = sentencepieces.PieceModel.of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in texts[:500]:
        a, b = uni.encode(t), lib.encode(t)
        assert a == b or abs(sum(uni.scores[i] for i in a) - sum(uni.scores[i] for i in b)) < 1e-2
    # whole documents: where ways tie, sums of scores are equal
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same = 0
    for t in docs:
        a, b = uni.encode(t), lib.encode(t)
        same += a == b
        assert a == b or abs(sum(uni.scores[i] for i in a) - sum(uni.scores[i] for i in b)) < 1e-6 * len(a) * 100
        assert uni.decode(a) == t
    assert same > 0.9 * len(docs)
    got = sentencepieces.encode(edge(spark), path)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.collect())
    assert collect(sentencepieces.decode(got, path), "doc_id", "text") == sorted(((a, b or "") for a, b in EDGE), key=repr)


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "y" * 40)] * 9 + [(None, None), (8, "z" * 500)]
    got = sharding.shard(edge(spark, rows), 200).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    for r in got:
        assert r.shard_bytes == sizes[r.shard]
        assert sizes[r.shard] <= 200 or r.n_bytes > 200
    names = {r.shard for r in got if "." not in r.shard}
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_sharding_one_large_row_of_a_hot_key(spark):
    sizes = [10] * 300 + [200, 199, 101, 100, 500, 0]
    got = sharding.shard(edge(spark, [(None, "x" * n) for n in sizes]).repartition(3), 200).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.n_bytes)
    assert sorted(r.n_bytes for r in got) == sorted(sizes) and all(r.shard_bytes == sum(shards[r.shard]) for r in got)
    assert all(sum(x) <= 200 or len(x) == 1 for x in shards.values())
    assert {n for x in shards.values() if len(x) == 1 for n in x} >= {200, 199, 101, 500}
    assert len(shards) <= 4 + 3100 // 100 + 1


def test_sharding_of_a_hot_key(spark):
    """Many alike rows of one key: runs within the limit, none lost, nothing depends on the chunks."""
    rows = [(None, "x" * (k % 7)) for k in range(3000)] + [(k, "y" * 9) for k in range(200)]
    whole = collect(sharding.shard(edge(spark, rows), 100), "doc_id", "n_bytes", "shard", "shard_bytes")
    size, sharding.CHUNK_ROWS = sharding.CHUNK_ROWS, 16
    try:
        assert collect(sharding.shard(edge(spark, rows).repartition(5), 100), "doc_id", "n_bytes", "shard", "shard_bytes") == whole
    finally:
        sharding.CHUNK_ROWS = size
    sizes = {}
    for _, n, name, _ in whole:
        sizes[name] = sizes.get(name, 0) + n
    assert len(whole) == len(rows) and sorted(r[1] for r in whole) == sorted(len(t) for _, t in rows)
    assert all(total == sizes[name] <= 100 for _, _, name, total in whole)
    assert len([name for name in sizes if "." in name]) <= 3000 * 3 // 94 + 2


def test_sharding_query_splits(spark):
    got = sharding.op2_sharding(spark, "/root/testdata/sf0.01")
    assert {r[0] for r in got.select("depth").distinct().collect()} >= {4, 5}


def test_packing(spark):
    lengths, demand = np.array([3, 5, 7]), np.array([30.0, 40.0, 20.0])
    columns, x = packing.column_generation(lengths, demand, 16)
    assert np.allclose(columns @ x, demand) and (lengths @ columns <= 16).all()
    # prices 1/6, 1/3 and 1/2 fit every pattern, so no solution is below their value
    assert abs(x.sum() - (30 / 6 + 40 / 3 + 20 / 2)) < 1e-9
    docs = [(i, "word " * ((i * 37) % 3000)) for i in range(60)] + EDGE
    got = packing.pack(edge(spark, docs), packing.default_tokenizer()).toPandas().sort_values(["sequence_id", "offset"])
    ends = got.offset + got.length
    assert (ends.groupby(got.sequence_id).shift().fillna(0) == got.offset).all() and ends.max() <= 2048
    padding = (2048 - ends.groupby(got.sequence_id).max()).sum()
    assert padding <= 2 * 2048 and set(got.sequence_id) == set(range(got.sequence_id.nunique()))
    tok = packing.WordTokenizer(packing.default_tokenizer())
    for i, text in docs[:60]:
        want = np.append(np.asarray(tok.inner.encode(text, add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        mine = got[(got.doc_id == i) & (got.doc_tokens == len(want))].drop_duplicates("start").sort_values("start")
        assert mine.length.sum() == len(want)
        assert all(zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())


def test_tokenizer_is_the_librarys():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    rng, pool = random.Random(1), "abcXYZ éèÉßöüñ'12²½¼ \n\t.,!?-_#*$%&|<>ǅǆİ \u0085\x1c中😀é’ſµªº"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(tok.encode([t])[0], "<u4").tolist() == tok.inner.encode(t, add_special_tokens=False).ids


def test_quality(spark):
    good = "Some words that make a line of prose, and it ends well. "
    texts = [good * 8, "\n".join([" ".join(f"w{i}x{k}" for k in range(8)) + "." for i in range(12)] + ["Home | About | Contact | Help"] * 2), "a b c a b c a b c", None, "", "### $$$ %%% &&&\n" * 30]
    got = {r.doc_id: r for r in quality.quality_rules(edge(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        covered = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
    assert got[1].kept and "About" not in got[1].clean_text and not got[5].kept and not got[3].kept
    assert quality.quality_rules(edge(spark)).count() == len(EDGE)


def test_chat(spark):
    call = '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"q","limit":2}},{"id":"b","name":"search","arguments":{"limit":"2"}}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 0, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[1,{"y":2,"x":1}]}}'), (1, 3, "tool", '{"tool_call_id":"zz"}'), (1, 0, "user", "hi"), (None, None, None, None)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.status) for r in got] == [(None, 0, "text"), (1, 0, "text"), (1, 1, "text"), (1, 2, "calls"), (1, 3, "result"), (1, 4, "orphan result")]
    assert got[3].n_calls == 2 and got[3].n_invalid == 1
    assert got[4].json == '{"content":{"content":{"b":[1,{"x":1,"y":2}],"z":1},"tool_call_id":"a"},"name":"search","role":"tool","turn":0}'


def chat_call(call_id, query, name="search"):
    return {"name": name, "arguments": {"query": query}} | ({} if call_id is None else {"id": call_id})


def chat_rows(spark, rows):
    return spark.createDataFrame([(c, t, role, x if isinstance(x, str) else json.dumps(x)) for c, t, role, x in rows], "conv_id long, turn int, role string, text string")


def test_chat_checks_every_call(spark):
    rows = [(1, t, "assistant", {"tool_calls": [chat_call("call_1", t if t % 2 else "q"), chat_call(None, 5), chat_call(None, "q")]}) for t in range(6)]
    # two messages of one turn, and one sent twice, count their own calls
    rows += [(2, 0, "assistant", {"tool_calls": [chat_call("a", 1), chat_call("a", 2)]}), (2, 0, "critic", {"tool_calls": [chat_call("a", "q")]}), *[(2, 1, "assistant", {"tool_calls": [chat_call("a", 3), None]})] * 2]
    got = chat.format_chat(chat_rows(spark, rows)).orderBy("conv_id", "turn", "role").collect()
    assert [(r.n_calls, r.n_invalid) for r in got] == [(3, 1 + t % 2) for t in range(6)] + [(2, 2), (1, 0), (2, 2), (2, 2)]


def test_chat_reports_calls(spark):
    rows = [
        (1, 0, "assistant", {"tool_calls": [chat_call("a", "q"), chat_call("b", "q", "nowhere"), chat_call(None, "q")]}), (1, 1, "tool", {"tool_call_id": "a"}),
        (1, 2, "assistant", {"tool_calls": [chat_call("b", "q"), chat_call("c", "q")]}), (1, 2, "critic", {"tool_calls": [{"id": "d"}]}), (1, 3, "tool", {"tool_call_id": "d"}),
        *[(None, None, None, {"tool_calls": [chat_call("a", "q")]})] * 2, (2, 0, "user", "hi"),
    ]
    got = chat.format_chat(chat_rows(spark, rows)).orderBy("conv_id", "turn", "role").collect()
    want = [(1, 0, 1)] * 2 + [(2, 1, 1), (0, 0, 0), (2, 0, 1), (0, 1, 0), (0, 0, 0), (0, 0, 0)]
    assert [(r.n_unanswered, r.n_no_schema, r.n_repeated) for r in got] == want


def brute_chat(rows):
    """Statuses and positions, message by message."""
    parsed = []
    for conv, turn, role, text in rows:
        try:
            j = json.loads(text) if text.lstrip().startswith("{") else None
        except ValueError:
            j = None
        parsed.append((conv, turn, role, text, j, (j or {}).get("tool_calls") or [], (j or {}).get("tool_call_id") if role == "tool" else None))
    first, times, answered, out = {}, {}, set(), []
    for conv, turn, _, _, _, calls, result_of in parsed:
        answered.add((conv, result_of))
        for k, c in enumerate(calls):
            if c.get("id") is not None:
                key = conv, c["id"]
                times[key] = times.get(key, 0) + 1
                first[key] = min(first.get(key, (turn, k, c["name"])), (turn, k, c["name"]))

    def valid(c):
        args, kinds = c.get("arguments"), {"search": {"query": str, "limit": int}, "calculate": {"expression": str}}.get(c["name"])
        return kinds is not None and isinstance(args, dict) and next(iter(kinds)) in args and all(type(args[f]) is t for f, t in kinds.items() if f in args)

    for conv, turn, role, text, j, calls, result_of in parsed:
        call = first.get((conv, result_of)) if result_of is not None else None
        status = "result" if call else "orphan result" if role == "tool" else "calls" if calls else "text"
        fields = {"content": text if j is None else j, "role": role, "turn": turn} | ({"name": call[2]} if call else {})
        dumped = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        place = (turn if call is None else max(turn, call[0]), 2 if role == "tool" else 1, turn, hashlib.md5(dumped.encode()).hexdigest())
        counts = len(calls), sum(not valid(c) for c in calls), sum((conv, c.get("id")) not in answered or c.get("id") is None for c in calls)
        out.append((conv, place, dumped, status, *counts, sum(c["name"] not in ("search", "calculate") for c in calls), sum(times.get((conv, c.get("id")), 0) > 1 for c in calls)))
    out.sort(key=lambda x: x[:2])
    return sorted((conv, sum(y[0] == conv for y in out[:k]), *rest) for k, (conv, _, *rest) in enumerate(out))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_chat_against_brute_force(spark, parts):
    rng = random.Random(int(parts))
    rows = []
    for k in range(400):
        conv, turn = rng.choice([1, 1, 1, 2, 3, k]), rng.randrange(12)  # one conversation has half of the rows
        kind = rng.randrange(5)
        if kind == 0:
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(15)}", "content": {"b": k % 3, "a": ["ü", None]}}, ensure_ascii=False)))
        elif kind == 1:
            calls = [chat_call(rng.choice([None, f"c{rng.randrange(15)}"]), rng.choice(["q", 5]), rng.choice(["search", "calculate", "other"])) for _ in range(rng.randint(1, 3))]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
        else:
            rows.append((conv, turn, rng.choice(["user", "system"]), rng.choice(["plain \"text\"\n", "{broken", "x" * 5000, str(k)])))
    rows += rows[:40]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn int, role string, text string, position int, status string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = collect(chat.format_chat(docs), "conv_id", "position", "json", "status", "n_calls", "n_invalid", "n_unanswered", "n_no_schema", "n_repeated")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(brute_chat(rows), key=repr)


def test_chat_query_has_work(spark):
    got = chat.op5_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert {r.status for r in got} == {"text", "calls", "result", "orphan result"}
    assert all(sum(getattr(r, n) for r in got) > 0 for n in ("n_calls", "n_invalid", "n_unanswered", "n_no_schema"))


def brute_components(rows):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = {d: d for d, _ in rows}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for (a, sa), (b, sb) in combinations(zip([d for d, _ in rows], sets), 2):
        if sa and sb and 100 * len(sa & sb) >= 80 * len(sa | sb):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for (d, _), s in zip(rows, sets))


def test_rows_without_a_partner_elsewhere_go(spark):
    rng = np.random.default_rng(5)
    rows = [(int(h), int(r), int(n), int(n * rng.uniform(0.8, 1.25)), int(c)) for h in range(60) for r, n, c in zip(range(int(rng.integers(1, 9))), rng.integers(5, 16, 9), rng.integers(0, 3, 9))]
    got = {tuple(r) for r in jaccard._with_partner_elsewhere(spark.createDataFrame(rows, "h long, rep long, n int, most int, comp long")).collect()}
    need = {a for a in rows if any(a[0] == b[0] and a[4] != b[4] and a[2] <= b[3] and b[2] <= a[3] for b in rows)}
    assert need <= got < set(rows)
    alone = {h for h in range(60) if len({r[4] for r in rows if r[0] == h}) == 1}
    assert not alone & {r[0] for r in got}


def test_contracted_links_join_only_what_is_connected(spark):
    moved = spark.createDataFrame([(2, 1), (9, 5)], "rep long, comp long")
    links = spark.createDataFrame([(2, 9), (9, 7), (7, 8), (8, 11), (11, 12), (20, 21)], "a long, b long")
    first = jaccard._relabelled(moved, jaccard._contract(jaccard._between(links, moved)))
    labels = {r.rep: r.comp for r in first.collect()}
    assert all(labels[k] in (1, 5, 7, 8, 11) and labels[k] < k for k in (2, 5, 7, 8, 9, 11, 12)) and labels[21] == 20
    last = {r.rep: r.comp for r in jaccard._relabelled(first, jaccard.components(jaccard._between(links, first))).collect()}
    assert last == {2: 1, 5: 1, 7: 1, 8: 1, 9: 1, 11: 1, 12: 1, 21: 20}


def test_jaccard(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One TWO"), (904, "one two three")]
    assert collect(jaccard.jaccard_components(edge(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=repr)
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(edge(spark)).collect()}
    assert {(1, 1), (None, 1), (4, 4), (5, 4), (2, 2), (3, 3)} <= got
    kept = jaccard.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_divide_skip():
    rng = np.random.default_rng(3)
    query = np.unique(rng.integers(0, 300, 120).astype(np.uint64))
    members = [np.unique(np.concatenate([rng.choice(query, int(len(query) * f)), rng.integers(0, 300, 10).astype(np.uint64)])) for f in rng.random(60) * 3]
    want = [k for k, m in enumerate(members) if 100 * len(np.intersect1d(query, m)) >= 80 * len(np.union1d(query, m))]
    assert jaccard.divide_skip(query, members).tolist() == want


def test_shingles_ignore_blocks():
    texts = ["a b c d e f g", None, "", "x y", "A b\tC d e\n"]
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == [next(iter(shingles.shingle_sets([t]))).tolist() for t in texts]


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40)]
        if i % 8 == 0:
            for _ in range(5):
                words[rng.randrange(40)] = rng.choice(["grubber", "snotling", "vilebag"])
        rows.append((i, " ".join(words)))
    docs = edge(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").collect()
    right = sum((r.predicted == 1) == (r.doc_id % 8 == 0) for r in got)
    assert right / len(got) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(edge(spark), toxicity.fit(docs, labels)).count() == len(EDGE)


def test_isotonic():
    knots, values = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_media(spark):
    got = media.media_columns(edge(spark)).collect()
    for r in got:
        text = next(b for a, b in EDGE if a == r.doc_id)
        payload, n = media.payload_of(text)
        assert media.from_wav(media.to_wav(payload)) == payload and len(payload) % 64 == 0 and r.n_bytes == n == len((text or "").encode())
        assert len(r.fp_time) == len(r.fp_code) and r.fp_time == sorted(r.fp_time)
    assert len({r.feature for r in got if r.doc_id in (2, 3)}) == 1


def brute_pairs(samples):
    """Peaks and pairs of one sound, bin by bin."""
    pad, hop = [128] * 64, media.HOP
    n = -(-len(samples) // hop) + 1
    x = np.array([*pad, *samples, *[128] * (n * hop)], float) - 128
    power = np.array([np.abs(np.fft.rfft(np.float32(x[k * hop : k * hop + 128]) * media._WINDOW)) for k in range(n)])
    value = lambda t, f: power[t][f] if 0 <= t < n and 0 <= f < power.shape[1] else 0.0
    peaks = {}
    for t in range(n):
        for b, (lo, hi) in enumerate(zip(media.BANDS, media.BANDS[1:])):
            top = [f for f in range(lo, hi) if value(t, f) > media.FLOOR and value(t, f) > max(value(t, f - 1), value(t, f + 1)) and value(t, f) >= max(value(t - 1, f), value(t + 1, f))]
            if top:
                peaks[t, b] = max(top, key=lambda f: (value(t, f), -f))
    return sorted((t, f << 16 | g << 8 | u - t) for (t, b), f in peaks.items() for (u, c), g in peaks.items() if t < u <= t + media.FAN_OUT or t == u and b < c)


def test_fingerprints_against_brute_force():
    rng = np.random.default_rng(7)
    sounds = [rng.integers(97, 123, n).astype(np.uint8) for n in (64, 128, 640, 64 * 41)] + [np.full(256, 128, np.uint8), rng.integers(0, 256, 320).astype(np.uint8)]
    for x, (t, c) in zip(sounds, media.fingerprints(sounds)):
        assert list(zip(t.tolist(), c.tolist())) == brute_pairs(x)
        alone = media.fingerprint(x)
        assert alone[0].tolist() == t.tolist() and alone[1].tolist() == c.tolist()
    assert [len(t) > 0 for t, _ in media.fingerprints(sounds)] == [True] * 4 + [False, True]
    long = rng.integers(0, 256, media.HOP * (media.BLOCK_FRAMES + 40)).astype(np.uint8)  # over a block's border
    t, c = media.fingerprint(long)
    assert list(zip(t.tolist(), c.tolist())) == brute_pairs(long)
    short = ["".join(map(chr, rng.integers(97, 123, 64))) for _ in range(100)]
    assert len({r[6] for r in media.describe(short)}) > 90


def test_media_digests(spark):
    rows = {r.doc_id: r for r in media.media_columns(edge(spark, [(k, t) for k, (_, t) in enumerate(EDGE)])).collect()}
    files = {r.doc_id: bytes(r.wav) for r in media.media_files(edge(spark, [(k, t) for k, (_, t) in enumerate(EDGE)])).collect()}
    for k, (_, text) in enumerate(EDGE):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[k]
        with wave.open(io.BytesIO(files[k])) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(files[k]), hashlib.sha256(files[k]).hexdigest())


def test_letters():
    model = langid.LanguageModel([], np.zeros((langid.BUCKETS, 0), np.float32), np.zeros(0))
    assert [model.predict(t)[2] for t in ("½ ²", "Ⅷ", "12 % _", "²a", "中", "\t")] == [True, True, True, False, False, True]


def test_language_learns_from_every_kind_of_row(spark):
    """A language whose texts are all long is learned; one that was never seen is rejected; blocks of long texts add up."""
    rng = random.Random(9)
    words = {"aa": ["thes", "wher", "ing", "tion"], "bb": ["quel", "eaux", "ment", "oire"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(6000 if lang == "bb" and i % 2 else 30)), lang) for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    rows += [(500, "quel eaux ment", ""), (None, "thes wher", "aa"), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs[-2:] == ["aa", "bb"] and sum(model.predict(t)[0] == lang for _, t, lang in rows[:120]) >= 118
    assert len(langid.identify(docs, model).collect()) == len(rows)
    long = " ".join(["quel eaux"] * 150_000)  # over a block's border
    whole, size = langid.LanguageModel(model.langs, model.scores, model.bias).logits(long), langid.BLOCK_BYTES
    langid.BLOCK_BYTES = 1 << 30
    try:
        assert np.allclose(whole, langid.LanguageModel(model.langs, model.scores, model.bias).logits(long))
    finally:
        langid.BLOCK_BYTES = size
    assert model.predict(" ".join(["щжф", "ъыэ", "юяц"] * 20))[2]


def test_language(spark):
    rng = random.Random(6)
    words = {"aa": ["thes", "wher", "ing", "tion"], "bb": ["quel", "eaux", "ment", "oire"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(400) for lang in [["aa", "bb"][i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert sum(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in got) >= 396
    odd = langid.identify(edge(spark, [(1, None), (2, "123 %"), (3, "thes ing")]), langid.fit(docs)).collect()
    assert [(r.lang_pred, r.rejected) for r in odd[:2]] == [("und", True)] * 2 and odd[2].lang_pred == "aa"


def test_url_trie_and_join_agree(spark):
    rng = random.Random(3)
    hosts = ["a.org", "b.a.org", "org", "com", "x.com", "A.com", "c.b.a.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/a//b", "/é/"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    pages = spark.createDataFrame([(k, rng.choice([None, "nothing", "http://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "x", "/y", "?q", "#f"])]), 1) for k in range(300)] * 2, "page_id long, url string, verdict int")
    want = collect(urls.judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    assert collect(urls.judge_by_join(pages, table), "page_id", "host", "path", "rule", "verdict") == want and len(want) == 600
    for k, host, path, rule, verdict in want:
        fits = [(len(h), len(p), a == "block", h.lower() + p, a) for h, p, a in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and host]
        assert (rule, verdict) == (max(fits)[3:] if fits else (None, "allow"))
    deep = urls.UrlTrie([("a.b", "/x" * 3000, "block")])
    assert deep.find("a.b", "/x" * 3000 + "/y") == ("a.b" + "/x" * 3000, "block") and deep.find("a.b", "/x" * 2999) is None


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://a.ORG/x", "org/", "allow"), ("https://b.example.org/en/12?q", "example.org/en/1", "block"), ("https://example.org/en/2", "org/", "allow"), ("http://xexample.org/es/", "org/", "allow"),
    ("http://a.com/de/#x", "com/de/", "block"), ("http://a.com/de", None, "allow"), ("http://a.org", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"),
])
def test_urls(spark, url, rule, verdict):
    row = urls.judge_urls(spark.createDataFrame([(1, url, "r")], "page_id long, url string, rule string")).first()
    assert (row.rule, row.verdict) == (rule, verdict)


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        query = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        members = [np.zeros(0, np.uint64), query]
        for share in (0.2, 0.7, 0.8, 0.9, 1.0):
            kept = query[rng.random(len(query)) < share]
            more = rng.integers(0, 1 << 63, int(rng.integers(0, len(query) // 3 + 2)), np.uint64)
            members.append(np.unique(np.concatenate([kept, more])))
        sizes = np.array([len(m) for m in members])
        overlap = np.array([len(np.intersect1d(query, m)) for m in members])
        links = set(np.flatnonzero(9 * overlap >= 4 * (len(query) + sizes)))
        left = set(jaccard.may_link(jaccard.bitmap(query), len(query), [jaccard.bitmap(m) for m in members], sizes))
        assert links <= left
        assert set(jaccard.divide_skip(query, members)) == links


@pytest.mark.parametrize("few", [0, 20_000])
def test_jaccard_joins_few_and_many_pairs_alike(spark, monkeypatch, few):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(300)) for _ in range(40))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(20)] + [(200 + i, rows[i % 3][1]) for i in range(9)]
    seen, search = [], jaccard._dealt

    def dealt(pairs, sets, fits, *columns):
        seen.append((columns, fits, sets.count()))
        return search(pairs, sets, fits, *columns)

    monkeypatch.setattr(jaccard, "_dealt", dealt)
    monkeypatch.setattr(jaccard, "FEW", few)
    assert collect(jaccard.jaccard_components(edge(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=repr)
    assert seen and all(fits == (few > 0) for _, fits, _ in seen)


def test_jaccard_makes_keys_anew_where_two_sets_share_one(spark, monkeypatch):
    own = jaccard._signature
    monkeypatch.setattr(jaccard, "_signature", lambda s, seed: own(s, seed) if seed else (1, own(s, 0)[1]))
    rows = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e")]
    assert collect(jaccard.jaccard_components(edge(spark, rows)), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_rows_without_an_id_link_and_one_of_a_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [(7, " ".join(base)), (None, near), (None, near), (None, "p q r s t u"), (None, "p q r s t u"), (None, ""), (None, "")]
    got = collect(jaccard.jaccard_components(edge(spark, rows)), "doc_id", "component_id")
    assert got == sorted([(7, 7), (None, 7), (None, 7), *[(None, None)] * 4], key=repr)
    kept = corpus_pipeline.near_duplicates(spark, edge(spark, rows), None)
    want = [(7, " ".join(base)), (None, "p q r s t u"), (None, ""), (None, "")]
    assert kept.columns == edge(spark).columns and collect(kept, "doc_id", "text") == sorted(want, key=repr)
    assert collect(jaccard.keep_one(edge(spark, rows)), "doc_id", "text") == sorted(rows, key=repr)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(9, other), (9, "k l m n o p"), (9, "k l m n o p"), (12, other + " end"), (13, "k l m n o p")]
    assert collect(jaccard.jaccard_components(edge(spark, rows)), "doc_id", "component_id") == sorted([(9, 9)] * 3 + [(12, 9), (13, 9)], key=repr)
    assert collect(jaccard.keep_one(edge(spark, rows)), "doc_id", "text") == sorted([(9, other), (9, "k l m n o p")], key=repr)
