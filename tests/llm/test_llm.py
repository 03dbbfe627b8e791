"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from knotwork.llm import chat, chunk_bpe, components, decontaminate, embedding_dups, line_dedup, minhash, packing, sharding, simhash, token_counts, token_files, weak_labels  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_lines string, note string"
ODD = ["", None, "a \n\nb", "don't x''re I'll'd", "<|endoftext|>  b", "   \n\n x  ", "中文字符 測試", "😀 x²½ Ⅷ", "a 　 b\x85c", "!\x1cb", "x" * 400, "\t\tfoo\r\n bar", "same", "same", "word " * 3000]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", None) for i, t in enumerate(texts)], DOCS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def ids_of(text):
    return np.array(library().encode(text or "", add_special_tokens=False).ids, dtype="<u4")


# ---- tokens


def test_chunks_give_the_ids_of_whole_texts():
    assert chunk_bpe.encoder(BPE).encode(ODD) == [ids_of(t).tobytes() for t in ODD]


def test_every_prefix_count():
    t = library()
    for text in ODD[:-1] + ["it's 'tis we'd've"]:
        got = np.cumsum(np.frombuffer(chunk_bpe.counter(BPE).count([text])[0], np.int8).astype(int)).tolist()
        assert got == [len(t.encode((text or "")[:k], add_special_tokens=False).ids) for k in range(1, len(text or "") + 1)]


@pytest.mark.parametrize("part", ["word\u00a0", "\u3000", "\u00a0", "<|endoftext|>", "a<|endoftext|>!", "\u4e2d\u6587", "x\u200by", "\U0001fae8\u3000z", "'s", " "])
def test_long_texts_of_odd_spaces_and_special_strings(part):
    counter, t = chunk_bpe.counter(BPE), library()
    short = part * 12
    got = np.cumsum(np.frombuffer(counter.count([short])[0], np.int8).astype(int)).tolist()
    assert got == [len(t.encode(short[:k], add_special_tokens=False).ids) for k in range(1, len(short) + 1)]
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = part * (1_000_000 // len(part.encode()) if len(part.encode()) != 1 else 50_000)
    deltas = counter.count([long])[0]
    assert int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64)) == len(t.encode(long, add_special_tokens=False).ids)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_prefix_table_answers_budgets(spark):
    df = token_counts.prefix_table(docs(spark, ["the cat sat", None]), BPE)
    got = df.select("doc_id", "n_bytes", "n_tokens", token_counts.tokens_at(F.col("prefix_deltas"), 7).alias("a"), token_counts.chars_within(F.col("prefix_deltas"), 2).alias("b")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 11, 3, 2, 7), (1, 0, 0, 0, 0)]
    assert token_counts.over_limit(docs(spark, []), BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32) >> np.random.default_rng(1).integers(0, 32, n, dtype=np.uint32)
    f = token_files.TokenFile(io.BytesIO(token_files.file_bytes([7, 9], [ids[: n // 3].astype("<u4").tobytes(), ids[n // 3 :].astype("<u4").tobytes()])))
    assert f.span(0, n).tolist() == ids.tolist() and f.span(n // 2, n).tolist() == ids[n // 2 :].tolist()
    assert [(d, a, x.tolist()) for d, a, x in f.documents(step=300)] == [(7, 0, ids[: n // 3].tolist()), (9, n // 3, ids[n // 3 :].tolist())]


def test_token_files_are_read_back_by_many_tasks(spark, tmp_path):
    manifest = token_files.write_token_files(docs(spark, ["some words of a text"] * 400), BPE, f"file://{tmp_path}/m", 2, 12)
    back = token_files.read_token_files(manifest)
    assert manifest.count() > 6 and back.count() == 400 and back.rdd.getNumPartitions() >= 4


def test_token_files_round_trip(spark, tmp_path):
    manifest = token_files.write_token_files(docs(spark, ODD), BPE, f"file://{tmp_path}/t", 2, 3)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_token_files(manifest).collect()}
    at = 0
    for i, t in enumerate(ODD):
        ids = np.append(ids_of(t), 2).astype("<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), BPE, f"file://{tmp_path}/e", 2, 3)).count() == 0


# ---- packing and sharding


def test_best_fit_places_all_within_capacity():
    loads = np.random.default_rng(3).integers(1, 101, 500).tolist()
    bins = packing.best_fit(loads, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(loads[i] for i in b) for b in bins) <= 100
    assert len(bins) <= 1.03 * sum(loads) / 100 + 1


def test_pack(spark):
    rows = docs(spark, [t for t in ODD] + ["one two three " * k for k in range(200)]).repartition(9)
    got = packing.pack(rows, BPE, 64, 2).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert set(by_doc) == set(texts)
    for d, rs in by_doc.items():
        ids, at = np.append(ids_of(texts[d]), 2).astype("<u4"), 0
        for k, r in enumerate(sorted(rs, key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes())) and (k == 0 or r["length"] == 64)
            at += r["length"]
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs(spark, []), BPE).count() == 0


def test_pack_fills_the_room_of_other_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "CARRY", 20, raising=False)
    monkeypatch.setattr(packing, "MEET", 100, raising=False)
    # A source of long texts in one partition and one of short texts in another: one of each fills a sequence.
    texts = ["one " * 39] * 200 + ["one " * 23] * 200
    assert {len(ids_of(t)) for t in texts[199:201]} == {40, 24}
    rows = docs(spark, texts[:200]).coalesce(1).unionAll(docs(spark, texts[200:], 200).coalesce(1))
    got = packing.pack(rows, BPE, 66, 2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert len({r["sequence_id"] for r in got}) < 250


def test_shards(spark):
    texts = [f"{'x' * (i * 37 % 211)}{i % 90}" for i in range(400)] + ["hot"] * 300 + [None, None, ""]
    got = sharding.shard(docs(spark, texts), 4).collect()
    loads, groups = Counter(), {}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t or "") + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        loads[r["shard"]] += r["size"]
        groups.setdefault(t, set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values()) and max(loads.values()) - min(loads.values()) < 300
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard(docs(spark, []), 4).count() == 0


# ---- near duplicates


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(3), np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(not diff & m for m in masks)
    for m in masks:
        assert any(not diff & f for f in simhash.finer_masks(m, 3)) or diff & m


def test_simhash_links_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False)) for b in base[:10] for _ in range(12)]
    fps = sorted({simhash.signed(x % (1 << 64)) for x in base + near})
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3).collect()

    def roots(pairs):
        up = {f: f for f in fps}
        def find(a):
            while up[a] != a:
                a = up[a]
            return a
        for a, b in pairs:
            up[find(max(a, b))] = find(min(a, b)) if find(a) != find(b) else up[find(max(a, b))]
        return [find(f) for f in fps]

    want = roots([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    same = lambda x: {frozenset(i for i, r in enumerate(x) if r == v) for v in set(x)}
    assert same(roots([(r["a"], r["b"]) for r in got])) == same(want)


def test_near_duplicates_edges(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, ["A b c d", "a B c d", None, "", "\t", "other words here now"])).collect()}
    assert got[1]["component_id"] == 0 and got[0]["fp"] == got[1]["fp"]
    assert {got[k]["component_id"] for k in (2, 3, 4)} == {2} and got[2]["fp"] == 0 and got[5]["component_id"] == 5
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, ["a b c d e f", "a b c d e f", "x y z"]), words=5)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == ["doc_id", "text", "n_lines", "note"]


def test_components(spark):
    rows = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + k: 100 for k in range(40)}}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    x = [*(centre + 0.15 * rng.standard_normal((60, 64))), *rng.standard_normal((60, 64))]
    x += [x[0], x[0] * 3, x[70]]
    rows = [(i, [float(v) for v in np.float32(e)], i % 7 == 0 and 1 or 0) for i, e in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] * 64, 0), (904, rows[0][1], None), (905, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dups.near_duplicates(df).collect()}
    u = np.array([r[1] for r in rows[:123]], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:123]])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(123, dtype=bool)
    assert [got[i]["n_links"] for i in range(123)] == link.sum(axis=1).tolist() and link.sum() > 500
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and len(got) == 129
    reach = link | np.eye(123, dtype=bool)
    while ((reach @ reach) != reach).any():
        reach = reach @ reach
    root = reach.argmax(axis=1)
    assert [got[i]["component_id"] for i in range(123)] == root.tolist() and [got[i]["kept"] for i in range(123)] == (root == np.arange(123)).tolist()
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0
    clash = embedding_dups.near_duplicates(df.withColumn("n_links", F.lit("x")).withColumn("keys", F.lit(1)))
    assert clash.columns == ["vec_id", "n_links", "component_id", "kept"] and clash.count() == 129


def test_embeddings_in_dense_buckets_and_under_repeated_ids(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = np.float32(centre + 0.02 * rng.standard_normal((3000, 16)))
    rows = [(i // 2 if i < 10 else i, [float(v) for v in e], "a") for i, e in enumerate(x)]
    got = embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    assert len(got) == 3000 and all(r["component_id"] == 0 for r in got) and {r["n_links"] for r in got if r["vec_id"] >= 10} == {2999}


# ---- lines and decontamination


def test_line_dedup(spark):
    long = "this is a line of some length"
    texts = [f"{long}\nshort\n\nown {long} a", f"{long}\n{long}s\nfresh text that is new here", "short\nshor", f"{long[:5]}X{long[6:]}", None, "", " \n", f"{long}\n\n", long[1:] + " and more", "shor"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.deduplicate(docs(spark, texts)).collect()}
    assert got == {
        0: (texts[0], 3, 3), 1: ("fresh text that is new here", 3, 1), 2: ("", 2, 0), 3: ("", 1, 0), 4: (None, 0, 0),
        5: ("", 0, 0), 6: (" \n", 0, 0), 7: ("\n", 1, 0), 8: (texts[8], 1, 1), 9: ("", 1, 0),
    }
    twice = docs(spark, ["a\nb"]).unionAll(docs(spark, ["a\nb"]))
    assert sorted((r["text"], r["n_kept"]) for r in line_dedup.deduplicate(twice).collect()) == [("", 0), ("a\nb", 2)]
    assert line_dedup.deduplicate(docs(spark, [])).count() == 0


def test_short_lines_against_every_pair(spark):
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("ab "), rng.integers(1, 9))) for _ in range(400)]
    texts = ["\n".join(lines[k : k + 8]) for k in range(0, 400, 8)]

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1 or len(b) < 5:
            return a == b
        return a == b or any((a[:k] + a[k + (len(a) == len(b)) :]) == (b[:k] + b[k + 1 :]) for k in range(len(b)))

    seen, want = [], []
    for t in texts:
        kept = []
        for x in t.split("\n"):
            if not x.strip() or not any(one_edit(x, y) for y in seen):
                kept.append(x)
            if x.strip():
                seen.append(x)
        want.append("\n".join(kept))
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def contaminated_by_hand(texts, items):
    """Every window of every text against every item."""

    def cut(t):
        v = t.lower().replace(",", " ").replace(".", " ").split()
        return [tuple(v[k : k + 5]) for k in range(len(v) - 4)] or ([tuple(v)] if v else [])

    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a, b = cut(t or ""), cut(item or "")
            m = min(len(a), len(b))
            best = max((sum((Counter(a[s : s + m]) & Counter(b)).values()) for s in range(len(a) - m + 1)), default=0) if m else 0
            if m and best / (len(b) + m - best) >= 0.8:
                want[d, i] = round(best / (len(b) + m - best), 6)
    return want


def test_decontaminate_near_the_similarity_and_with_repeated_phrases(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items, texts = [], []
    for k in range(40):
        phrase, other = [word() for _ in range(6)], [word() for _ in range(6)]
        w = [word() for _ in range(24 + k % 3)] if k % 2 else (phrase * 2 + other * 2 + phrase)[: 24 + k % 3]
        items.append(" ".join(w))
        # Words put in front move the passage, and some at an end are others: 0 to 4 of about 20 shingles are lost.
        texts.append(" ".join([word() for _ in range(int(rng.integers(0, 30)))] + w[: len(w) - k % 5] + [word() for _ in range(30)]))
    texts += ["very " * 400, " ".join((phrase * 2 + other * 2) * 16)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    want = contaminated_by_hand(texts, items)
    assert got == want and 20 < len(want) < 40


def test_decontaminate(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [" ".join(word() for _ in range(n)) for n in (40, 20, 60)] + ["tiny item", "", None]
    w = items[2].split()
    texts = [f"Before, {items[0].upper()}. After", " ".join(word() for _ in range(300)), items[1][: len(items[1]) // 3], " ".join([*w[:58], "zz", w[59]]), "tiny item", None, "", " ".join(w[30:] + w[:30]), f"{items[1]} {items[1]}"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}

    want = contaminated_by_hand(texts, items)
    assert got == want and len(want) >= 5
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


# ---- chat and classifier


def test_escapes_are_reversible():
    for t in ["<|im_end|>", "<\\|x", "<\\\\|", "a<|b|>c", "\\", "<", "|", "", "<\\"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n" + t)) == t + "\n" + t


def test_chat(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", tricky), (1, 0, "user", tricky), (2, 0, "assistant", "early"), (2, 1, None, None), (2, 2, "a\nb", ""), (None, 0, "user", "x"), (3, 5, "user", "tie"), (3, 5, "user", "tie")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    flags = {(r["conv_id"], r["turn_no"]): r["in_order"] for r in made.collect()}
    assert flags[1, 0] and flags[1, 1] and not flags[2, 0]
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    want = hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest() and got[1]["loss_chars"] == len(tricky)
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == hashlib.sha256(b"assistant\nearly\n\n\na\nb\n\n").hexdigest()
    assert set(got) == {1, 2, 3, None} and got[3]["n_turns"] == 2
    assert chat.digests(chat.format_conversations(made.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_expectation_maximisation_finds_rates():
    rng = np.random.default_rng(0)
    bad = rng.random(20000) < 0.2
    rate = np.where(bad[:, None], [0.8, 0.7, 0.6, 0.5], [0.02, 0.03, 0.01, 0.05])
    fired = rng.random((20000, 4)) < rate
    counts = Counter((fired @ [1, 2, 4, 8]).tolist())
    shares, (good, hit) = weak_labels.expectation_maximisation(counts, 4)
    assert abs(shares[1] - 0.2) < 0.02 and np.abs(hit - [0.8, 0.7, 0.6, 0.5]).max() < 0.04 and good.max() < 0.08


def test_expectation_maximisation_of_two_kinds_of_bad_documents():
    # Three labellers of each kind: two alone would leave a kind's share and rates open.
    rng = np.random.default_rng(0)
    kind = rng.choice(3, 30000, p=[0.75, 0.15, 0.1])
    rate = np.array([[0.01] * 6, [0.8, 0.7, 0.6, 0.01, 0.01, 0.01], [0.01, 0.01, 0.01, 0.9, 0.8, 0.7]])
    counts = Counter(((rng.random((30000, 6)) < rate[kind]) @ [1, 2, 4, 8, 16, 32]).tolist())
    shares, rates = weak_labels.expectation_maximisation(counts, 6, kinds=(range(3), range(3, 6)))
    assert np.abs(shares - [0.75, 0.15, 0.1]).max() < 0.02 and np.abs(rates - rate).max() < 0.05


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("lmnopqrst"), 5)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary, 60))
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        t = text()
        if kind == 0:
            t += " you idiot moron clown"
        elif kind == 1:
            t = " | ".join(t.split()) + " $$$ ### %%%" * 5
        rows.append((i, t))
        if i < 300:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(900, None), (901, ""), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in weak_labels.classify(df, lab).collect()}
    right = [got[i] == (i % 6 < 2) for i in range(300, 600)]
    assert np.mean(right) > 0.97 and not got[900] and not got[901]
    kept = weak_labels.keep_good(df, lab)
    assert kept.columns == df.columns and 380 <= kept.count() <= 420
    assert weak_labels.classify(df.limit(0), lab.limit(0)).count() == 0


def test_similar_texts_of_five_word_shingles(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("lmnopqrst"), 5)) for _ in range(500)]
    texts = []
    for _ in range(40):
        w = list(rng.choice(vocabulary, 200))
        texts.append(" ".join(w))
        w[int(rng.integers(200))] = "changed"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class"] for r in simhash.similar_classes(docs(spark, texts)).collect()}
    joined = sum(got[2 * k] == got[2 * k + 1] for k in range(40))
    assert joined >= 36 and len(set(got.values())) == 80 - joined


def test_texts_at_the_similarity_are_linked_and_below_it_are_not(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("lmnopqrst"), 5)) for _ in range(500)]
    texts = []
    for k in range(60):
        w = list(rng.choice(vocabulary, 204))
        # 178 of 222 shingles are shared (0.802), or 177 of 223 (0.794).
        other = 22 if k < 40 else 23
        texts += [" ".join(w), " ".join([*w[:-other], *(f"new{j}" for j in range(other))])]
    got = {r["doc_id"]: r["class"] for r in simhash.similar_classes(docs(spark, texts)).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(60)] == [k < 40 for k in range(60)] and len(set(got.values())) == 80


def test_similar_classes_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_SETS", 4)
    rng = np.random.default_rng(8)
    w = [f"w{k}" for k in range(64)]
    texts = [" ".join(w)]
    for k in range(40):
        at = int(rng.integers(64))
        texts.append(" ".join([*w[:at], f"x{k}", *w[at + 1 :]]))
    texts += [None, "", " \n", "few words", "few WORDS"]
    got = [r["class"] for r in simhash.similar_classes(docs(spark, texts)).orderBy("doc_id").collect()]
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [want[b] if x == want[a] else x for x in want]
    assert [got.index(x) for x in got] == [want.index(x) for x in want] and len(set(want)) == 3


def test_bits_of_sets_differ_by_their_angle():
    rng, trials = np.random.default_rng(9), 100
    bits, bands, radius = simhash.banding(0.8, 1000)
    hashing = simhash._hashing((simhash.PRINT + bits * bands) // simhash.WEIGHTS)
    for shared, a, b in [(8, 1, 1), (40, 5, 5), (160, 0, 40)]:
        differ = []
        for _ in range(trials):
            x = rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64) * np.uint64(2)
            differ.append(simhash.set_bits(x[: shared + a], *hashing) != simhash.set_bits(np.delete(x, slice(shared, shared + a)), *hashing))
        cosine = shared / ((shared + a) * (shared + b)) ** 0.5
        assert abs(np.mean(differ) - np.arccos(cosine) / np.pi) < 0.006
        # Every pair at the similarity shares a band and has prints within the radius.
        assert all((~d[simhash.PRINT :].reshape(-1, bits).any(axis=1)).any() and d[: simhash.PRINT].sum() <= radius for d in differ)


def test_similar_texts_are_found_by_simhash_alone(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:-20], *(f"new{k}" for k in range(20))])]
    df = docs(spark, texts)
    assert simhash.keep_one(df).count() == 1
    # The same texts with prints that are never within the radius: no other way finds them.
    monkeypatch.setattr(simhash, "banding", lambda similarity, n: (16, 4, -1))
    assert simhash.keep_one(df).count() == 2


def test_candidates_of_large_buckets(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "ROWS", 16)
    rng, radius = np.random.default_rng(10), 40
    flipped = lambda x, n: x ^ np.bincount(rng.choice(192, n, replace=False), minlength=192).astype(bool)
    bases = rng.random((60, 192)) < 0.5
    # A large group in one bucket, a chain that leaves it, and others that share its bucket or another by chance.
    prints = [flipped(bases[0], int(rng.integers(1, 15))) for _ in range(90)]
    prints += [flipped(b, int(rng.integers(0, 30))) for b in bases[1:30] for _ in range(3)] + list(bases[30:])
    link = prints[0]
    for _ in range(6):
        link = flipped(link, 35)
        prints.append(link)
    bands = [[0 if k < 90 or k >= 207 else int(rng.integers(0, 2)), int(rng.integers(0, 3))] for k in range(len(prints))]
    raw = np.packbits(np.array(prints), axis=1, bitorder="little").view(np.int64)
    rows = [(*map(int, r), b) for r, b in zip(raw, bands)]
    got = simhash.candidates(spark.createDataFrame(rows, "p0 long, p1 long, p2 long, bands array<int>"), 16, radius)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if any(x == y for x, y in zip(bands[a], bands[b])) and (prints[a] != prints[b]).sum() <= radius]

    def classes(pairs):
        up = list(range(len(rows)))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    # Prints of the same first word are one node.
    number = {int(r[0]): k for k, r in enumerate(raw)}
    same = [(k, number[int(r[0])]) for k, r in enumerate(raw)]
    assert classes([(number[r["a"]], number[r["b"]]) for r in got.collect()] + same) == classes(near + same)

    # A large bucket is given back as it comes, whole, and its neighbours are linked.
    keys = np.repeat([1, 2, 3], [3, 200, 3])
    words = [np.arange(206) << 40, np.zeros(206, dtype=np.int64), np.zeros(206, dtype=np.int64)]
    table = pa.table([pa.array(x) for x in (keys, 0 * keys, 0 * keys, *words)], names=["key", "i", "j", "p0", "p1", "p2"])
    out = pa.Table.from_batches(simhash._print_links(radius, 8)(iter(table.to_batches(max_chunksize=5)))).to_pylist()
    assert sorted(r["p0"] for r in out if r["a"] is None) == words[0][3:203].tolist() and {r["key"] for r in out if r["a"] is None} == {2}
    assert {r[c] for r in out if r["a"] is not None for c in "ab"} == set(words[0][[0, 1, 2, 203, 204, 205]].tolist())


def test_links_of_near_copies_grow_with_their_number(spark):
    import pyarrow as pa

    rng, n, bands = np.random.default_rng(12), 120, 40
    prints = rng.random((n, 192)) < np.repeat([0, 0.02], [64, 128])
    raw = np.packbits(prints ^ (rng.random(192) < 0.5), axis=1, bitorder="little").view(np.int64)
    # Another first word each, so that each is a node.
    raw[:, 0] ^= np.arange(n) << 32
    rows = [(*map(int, r), rng.integers(0, 3, bands).tolist()) for r in raw]
    got = simhash.candidates(spark.createDataFrame(rows, "p0 long, p1 long, p2 long, bands array<int>"), 16, 60).collect()
    assert n - 1 <= len(got) <= n * (simhash.FIRST + 1)
    assert len(set(r["root"] for r in components.components(spark.createDataFrame(got, "a long, b long")).collect())) == 1

    def made(keys, nodes=None, most=8):
        first = (np.arange(len(keys)) << 40) + 1
        columns = {"key": np.array(keys), "i": np.zeros(len(keys), dtype=np.int64), "j": np.zeros(len(keys), dtype=np.int64), "p0": first, "p1": 0 * first, "p2": 0 * first}
        table = pa.table({c: pa.array(x) for c, x in columns.items()} | ({} if nodes is None else {"node": pa.array(nodes, pa.int64())}))
        return [r for b in simhash._print_links(8, most)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]

    # Small buckets and larger ones give a forest, the same one twice included.
    assert len(made([1] * 60, most=100)) == 59 and len(made([1] * 90, most=100)) == 89
    assert len(made([1] * 60 + [2] * 60, [*range(60)] * 2, most=100)) == 59
    # What is joined already gives nothing, however large, and others one link to all of it.
    assert made([1] * 200, [5] * 200) == []
    assert {frozenset((r["a"], r["b"])) for r in made([1] * 30, [5] * 29 + [9], most=10)} == {frozenset((5, 9))}
    assert {r["a"] for r in made([1] * 30, [5] * 15 + [None] * 15)} == {None}


def test_candidates_of_later_bands(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FIRST", 1)
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "ROWS", 16)
    rng, radius = np.random.default_rng(13), 40
    flipped = lambda x, n: x ^ np.bincount(rng.choice(192, n, replace=False), minlength=192).astype(bool)
    bases = rng.random((40, 192)) < 0.5
    # A group that the first band joins in two halves, chains out of it, and others that share buckets by chance.
    prints = [flipped(bases[0], int(rng.integers(1, 15))) for _ in range(80)]
    prints += [flipped(b, int(rng.integers(1, 30))) for b in bases[1:20] for _ in range(3)] + list(bases[20:])
    for start in (0, 40):
        link = prints[start]
        for _ in range(5):
            link = flipped(link, 35)
            prints.append(link)
    bands = [[k // 40 if k < 80 else int(rng.integers(0, 40)), int(rng.integers(0, 2)), int(rng.integers(0, 30))] for k in range(len(prints))]
    raw = np.packbits(np.array(prints), axis=1, bitorder="little").view(np.int64)
    rows = [(*map(int, r), b) for r, b in zip(raw, bands)]
    got = simhash.candidates(spark.createDataFrame(rows, "p0 long, p1 long, p2 long, bands array<int>"), 16, radius)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if any(x == y for x, y in zip(bands[a], bands[b])) and (prints[a] != prints[b]).sum() <= radius]

    def classes(pairs):
        up = list(range(len(rows)))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    # Prints of the same first word are one node.
    number = {int(r[0]): k for k, r in enumerate(raw)}
    same = [(k, number[int(r[0])]) for k, r in enumerate(raw)]
    want = classes(near + same)
    assert classes([(number[r["a"]], number[r["b"]]) for r in got.collect()] + same) == want and len(set(want)) > 20


def test_verified_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_SETS", 4)
    monkeypatch.setattr(minhash, "PAIRED", 1, raising=False)
    made, real = [], minhash.verified_links
    monkeypatch.setattr(minhash, "verified_links", lambda *a, **k: made.append(real(*a, **k)) or made[0])
    w = [f"w{k}" for k in range(200)]
    texts = [" ".join([*w[:k], f"x{k}", *w[k + 1 :]]) for k in range(60)]
    assert len({r["class"] for r in simhash.similar_classes(docs(spark, texts)).collect()}) == 1
    assert 59 <= made[0].count() <= 2 * 60


def test_similar_classes_of_very_large_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRED", 2)
    test_similar_classes_of_large_buckets(spark, monkeypatch)
