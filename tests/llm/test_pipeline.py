"""run() against a version in plain Python: loops over rows, all pairs of documents, one pass of packing."""

import numpy as np
import pyarrow as pa

from namewell.llm import language, near_dup, packing, private, toxicity
from namewell.llm.textkernel import shingles, words_of

DIR = "/root/testdata/sf0.001"


def languages(rows, model):
    """Rows that the fused evidence can tell, with its language, by plain arithmetic."""
    ll, n, strange = model.likelihoods(pa.array([r["text"] for r in rows]))
    k = len(model.langs)
    votes = [int(np.argmax(ll[i])) if n[i] > 0 and strange[i] < language.UNKNOWN else None for i in range(len(rows))]
    one = lambda v: np.array([1.0 if v == j else 0.0 for j in range(k)])
    count = lambda key: {x: sum((one(v) for r, v in zip(rows, votes) if r[key] == x), np.zeros(k)) for x in {r[key] for r in rows}}
    whole, host = sum((one(v) for v in votes), np.zeros(k)), count("source")
    kept = []
    for i, r in enumerate(rows):
        p = np.full(k, 1 / k)
        # a source has one label, so suffix, domain and host are the same counts
        for c in (whole, *[host[r["source"]]] * 3):
            c = np.maximum(c - one(votes[i]), 0)
            p = (c + language.PSEUDO * p) / (c.sum() + language.PSEUDO)
        said = np.array([np.log(language.DECLARED) if x == r["lang"] else np.log((1 - language.DECLARED) / (k - 1)) for x in model.langs]) if r["lang"] in model.langs else 0
        logs = ll[i] + said + np.log(p)
        if n[i] == 0:
            kept.append(r)
        elif 1 / np.exp(logs - logs.max()).sum() >= language.MIN_POSTERIOR and strange[i] < language.UNKNOWN:
            kept.append(r | {"lang": model.langs[int(np.argmax(logs))]})
    return kept


def one_of_each_group(rows):
    h, b = shingles(words_of(pa.array([r["text"] for r in rows])), near_dup.SIZE)
    prints, least = near_dup.wide_fingerprints(h, b), near_dup.minima(h, b)
    bands = least.reshape(len(rows), near_dup.BANDS, -1)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if b[i + 1] > b[i] and b[j + 1] > b[j] and (bands[i] == bands[j]).all(1).any() and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= near_dup.RADIUS * near_dup.WORDS:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]  # rows come in the order of their ids


def test_near_copies_of_large_shards(spark, monkeypatch):
    """The stage keeps the same rows, those of plain Python, when shards are large for the bound on their size."""
    import corpus_pipeline

    monkeypatch.setattr(near_dup.groups, "__defaults__", ("doc_id", "text", near_dup.RADIUS, 2))
    r = np.random.default_rng(9)
    words = lambda n: [f"w{i}" for i in r.integers(0, 9000, n)]
    rows = []
    for i in range(12):  # versions that drift apart from the first, one after the other
        text = words(150)
        for j in range(10):
            for k in r.integers(0, 150, 4):
                text[k] = words(1)[0]
            rows.append({"doc_id": 100 * i + j, "text": " ".join(text), "lang": "en", "source": "x", "n_chars": 1})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, DIR).collect()) == [r["doc_id"] for r in one_of_each_group(rows)]


def test_near_copies_that_share_no_band(spark, monkeypatch):
    """The stage joins all that a chain of pairs within the radius joins, whether or not they share a band, however the work is cut."""
    import corpus_pipeline

    r = np.random.default_rng(3)
    rows = []
    for i in range(150):  # a text and one with 17 of its 150 words changed, about as far apart as the radius
        text = [f"w{k}" for k in r.integers(0, 9000, 150)]
        rows.append({"doc_id": 2 * i, "text": " ".join(text), "lang": "en", "source": "x", "n_chars": 1})
        for k in r.choice(150, 17, replace=False):
            text[k] = f"v{k}"
        rows.append({"doc_id": 2 * i + 1, "text": " ".join(text), "lang": "en", "source": "x", "n_chars": 1})
    h, b = shingles(words_of(pa.array([x["text"] for x in rows])), near_dup.SIZE)
    prints, bands = near_dup.wide_fingerprints(h, b), near_dup.minima(h, b).reshape(len(rows), near_dup.BANDS, -1)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= near_dup.RADIUS * near_dup.WORDS]
    assert sum(not (bands[i] == bands[j]).all(1).any() for i, j in near) >= 2 and all(i == j + 1 and j % 2 == 0 for i, j in near)
    want = sorted({x["doc_id"] for x in rows} - {i for i, _ in near})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(x["doc_id"] for x in stage(spark, docs, DIR).collect()) == want
    monkeypatch.setattr(near_dup.links, "__defaults__", (near_dup.SHARD, 70))
    assert sorted(x["doc_id"] for x in stage(spark, docs, DIR).collect()) == want


def test_every_pair_is_met_once():
    """Blocks of any size: each pair within the radius that shares no band, and no other, comes from one of its two nodes."""
    r = np.random.default_rng(4)
    base, radius = r.integers(0, 1 << 63, (6, near_dup.WORDS), dtype=np.uint64), near_dup.RADIUS * near_dup.WORDS
    flip = lambda p, bits: p ^ np.packbits(np.isin(np.arange(256), r.choice(256, bits, replace=False))).view(np.uint64)
    prints = np.stack([flip(base[i % 6], int(r.integers(0, 50))) for i in range(90)])
    least = r.integers(0, 3, (90, near_dup.MINIMA)).astype(np.int32)
    least[30:] = r.integers(0, 1 << 30, (60, near_dup.MINIMA))
    x = np.sort(r.choice(1 << 35, 90, replace=False))
    sketches = np.frombuffer(b"".join(p.tobytes() + m.tobytes() for p, m in zip(prints, least)), np.uint8).reshape(90, -1)
    bands = least.reshape(90, near_dup.BANDS, -1)
    want = [(int(x[i]), int(x[j])) for i in range(90) for j in range(i + 1, 90) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius and not (bands[i] == bands[j]).all(1).any()]
    for size, step in ((90, 90), (7, 11), (1, 5)):
        got = []
        for k in range(0, 90, size):
            block = near_dup.Block(x[k : k + size], sketches[k : k + size])
            for m in range(0, 90, step):
                got += [(min(p), max(p)) for a, b in block.meet(x[m : m + step], sketches[m : m + step], radius) for p in zip(a.tolist(), b.tolist())]
        assert sorted(got) == want and want


def test_run_equals_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{DIR}/labels.parquet")))
    rows = [r for r in rows if model.score(r["text"]) < model.cutoff]
    left = spark.createDataFrame(rows, docs.schema)
    rows = languages(rows, language.fit(language.labelled(left)))
    rows = one_of_each_group(rows)
    redacted = {r["doc_id"]: r["text"] for r in private.redact(spark.createDataFrame(rows, docs.schema)).collect()}
    spans = {}
    for s in private.spans(spark.createDataFrame(rows, docs.schema)).collect():
        spans.setdefault(s["doc_id"], []).append((s["start"], s["stop"], s["kind"]))
    for r in rows:
        text = r["text"]
        for a, b, kind in sorted(spans.get(r["doc_id"], []), reverse=True):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        assert redacted[r["doc_id"]] == text
    keys, counts = packing.curve_keys(pa.array([redacted[r["doc_id"]] for r in rows]))
    want, at = [], 0
    for key, i, n in sorted(zip(keys.tolist(), [r["doc_id"] for r in rows], counts.tolist())):
        done = 0
        while done < n:
            take = min(n - done, packing.CAPACITY - at % packing.CAPACITY)
            want.append((i, at // packing.CAPACITY, at % packing.CAPACITY, done, take, key))
            at, done = at + take, done + take
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(want)
