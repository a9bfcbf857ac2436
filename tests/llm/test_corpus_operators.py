"""Near-duplicates, decontamination, classifiers and chat links against plain versions, with edge cases."""

import random
import re
from collections import Counter

import numpy as np

from twinsight.llm import chat_format, decontamination, language_id, near_dedup, quality_classifier
from twinsight.llm._shared import BLOCK, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)


def plain_components(rows, width):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    low = {k: rows[k][0] for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {rows[k][0]: (len(sets[k]), low[k]) for k in sets}


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(9000)}"
    return " ".join(words)


def test_near_duplicates_equal_plain_version(spark):
    rng = random.Random(3)
    rows = [(100, None), (101, ""), (102, "one"), (103, "ONE"), (104, "one two"), (105, "É é"), (106, "é É")]
    for g in range(12):
        seed = [f"w{rng.randrange(9000)}" for _ in range(60)]
        rows += [(1000 + 100 * g + k, mutated(rng, seed, rng.randrange(0, 6))) for k in range(rng.randrange(1, 9))]
    hub = [f"v{k}" for k in range(120)]
    rows += [(5000 + k, mutated(rng, hub, rng.randrange(0, 14))) for k in range(60)]
    rng.shuffle(rows)
    for width in (2, 5):
        expected = plain_components(rows, width)
        got = near_dedup.near_duplicates(frame(spark, rows), width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nulls_and_nothing(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "x y z"), (2, "x y z"), (None, None)]
    got = near_dedup.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == [("2", 2, 2), ("4", 2, 2), ("4", 2, 4), ("None", 0, None), ("None", 2, 4)]
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0), 2).count() == 0


def test_pigeonhole_keys_meet():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (300, near_dedup.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 256, near_dedup.DISTANCE, dtype=np.uint8)
    assert (near_dedup.bucket_keys(a) == near_dedup.bucket_keys(b)).any(1).all()


def test_wand_finds_all_above_threshold():
    rng = random.Random(6)
    words = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words[: rng.choice((20, 300))]) for _ in range(rng.randint(1, 30)))) for k in range(150)]
    index = decontamination.Index([*items, (999, ""), (998, "...")])
    weights = np.zeros((len(index.terms), len(index.items)))
    for t, (ns, ws) in enumerate(zip(index.numbers, index.weights, strict=True)):
        weights[t, ns] = ws
    hits = 0
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)))
        for threshold in (0.1, 0.3, 0.6):
            bound = index.maxima[terms].sum(0) >= threshold - 1e-6
            expected = [k for k, s in enumerate(weights[terms].sum(0)) if s >= threshold - 1e-9]
            hits += len(expected)
            assert sorted(k for k, _ in index.search(terms, bound, threshold)) == expected
    assert hits


def test_leaks_are_found_and_only_they(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60))) + f". Answer {word()} {word()}.") for k in range(40)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, expected = [(900, None), (901, ""), (902, "a b")], set()
    for k in range(120):
        text = filler(rng.randint(0, 300))
        if k % 3 == 0:
            item = rng.choice(items)
            text += (" " if k % 2 else "!!") + item[1].upper() + "\n" + filler(rng.randint(0, 300))
            expected.add((k, item[0]))
        elif k % 3 == 1:
            text += " " + " ".join(rng.choice(items)[1].split()[:6])
        docs.append((k, text))
    bench = spark.createDataFrame(items + [(77, None), (78, "")], "item_id long, text string")
    df = frame(spark, docs)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect()} == expected
    left = {r["doc_id"] for r in decontamination.without_leaks(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontamination.find_leaks(df, bench.limit(0)).count() == 0 and decontamination.find_leaks(df.limit(0), bench).count() == 0
    sliced = list(decontamination.slices(bench, slice_bytes=3000))
    assert len(sliced) > 2 and sorted(x for part, _ in sliced for x in part) == sorted([*items, (78, "")])
    # Cuts change no score: each item's weights are those of one index over the whole benchmark.
    weights = lambda own: {(i.terms[t], i.items[n].item_id): w for i in own for t, (ns, ws) in enumerate(zip(i.numbers, i.weights, strict=True)) for n, w in zip(ns, ws, strict=True)}
    whole = weights(decontamination.indexes([*items, (78, "")]))
    assert {k: round(w, 9) for part, corpus in sliced for k, w in weights(decontamination.indexes(part, corpus)).items()} == {k: round(w, 9) for k, w in whole.items()}


def test_a_long_item_keeps_short_passages(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    short, long = (" ".join(word() for _ in range(n)) for n in (20, 3000))
    own = decontamination.indexes([(1, short), (2, long)])
    assert [i.passage for i in own] == [decontamination.MIN_PASSAGE, 6000]
    texts = [f"{word()} {short} {word()}", f"{long} {short}", " ".join(word() for _ in range(5000)), short[:50]]
    found = decontamination.find_leaks(frame(spark, [(k, t) for k, t in enumerate([*texts, texts[0]])]), spark.createDataFrame([(1, short), (2, long)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 1), (1, 1), (1, 2), (4, 1)]


def test_gradients_equal_differences():
    net = language_id.Network.new(["a", "b", "c"], hidden=3, seed=1)
    x, live = language_id.padded([b"abc", b"de", b"f"])
    y = np.array([0, 1, 2])
    _, pairs = net.gradients(x, live, y)
    for p, g in pairs:
        flat, grad = p.reshape(-1), g.reshape(-1)
        for k in np.argsort(-abs(grad))[:4]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = net.gradients(x, live, y)[0]
            flat[k] = old - 1e-2
            down = net.gradients(x, live, y)[0]
            flat[k] = old
            assert abs((up - down) / 2e-2 - grad[k]) < 2e-3


def test_pooled_positions_equal_the_network_run_plainly():
    net, rng = language_id.Network.new(["a", "b", "c"], hidden=4, seed=3), random.Random(5)
    size, extra = language_id.WINDOW, language_id.CONTEXT
    lengths = [0, 1, 5, size - 1, size, size + 1, size + extra, 3 * size + 7, 40 * size]
    texts = [bytes(rng.choice(b"aZ z.09\xc3\xa9\n") for _ in range(n)) for n in lengths] + [b"12 ..", b" " * size + b"x" + b" " * size]
    logs, positions = language_id.pooled(net, texts)
    for k, text in enumerate(texts):
        text, total, n = text.lower(), np.zeros(3), 0
        for at in range(0, len(text), size):
            left = max(0, at - extra)
            x, live = language_id.padded([text[left : at + size + extra]])
            labels = net.run(x, live)[0][:, 0]
            for place in range(at, min(at + size, len(text))):
                if 97 <= text[place] <= 122 or text[place] >= 128:
                    total, n = total + labels[place - left], n + 1
        assert positions[k] == n
        assert np.allclose(logs[k] * max(n, 1), total, atol=1e-3 * max(n, 1))


def test_labels_depend_on_the_words_around():
    net = language_id.Network.new(["a", "b"], hidden=4, seed=3)
    one, two = (language_id.padded([t])[0] for t in (b"xyz same", b"abc same"))
    live = np.ones(one.shape, np.float32)
    assert not np.allclose(net.run(one, live)[0][4:], net.run(two, live)[0][4:], atol=1e-6)


def test_language_of_unseen_texts(spark):
    rng = random.Random(2)
    vocabulary = {"xx": ["ka", "lo", "mira", "kato"], "yy": ["szu", "grr", "öst", "wrz"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 30))), lang) for k in range(200) for lang in [rng.choice(["xx", "yy"])]]
    df = frame(spark, [*rows, (1000, None, "xx"), (1001, "123 ...", "yy"), (1002, "ka lo", None), (None, "ka lo mira", "xx")])
    texts, langs = language_id.training_rows(df)
    net = language_id.train(texts, langs, steps=120, windows_per_lang=500)
    out = {r["doc_id"]: r for r in language_id.identify(df, net).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang in rows) and any(r["held_out"] for r in out.values())
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == "und" and out[1002]["lang_pred"] == "xx" and out[None]["held_out"] is False
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}


def test_every_language_is_learned_from(spark):
    rows = [(10 * k + j, f"w{k}", f"l{k}") for k in range(70) for j in range(10)] + [(9001, "x", "l0")] * 50
    texts, langs = language_id.training_rows(frame(spark, rows), per_lang=4)
    assert set(langs) == {f"l{k}" for k in range(70)} and len(texts) == len(langs)
    assert max(map(langs.count, set(langs))) <= 4


def plain_statistics(text):
    """The statistics of a text, by their names."""
    words, lines = re.findall(rb"[^\x20\x09-\x0d]+", text), [x for x in text.split(b"\n") if x.strip()]
    low, n = [w.lower() for w in words], max(1, len(words))
    pairs, chars = list(zip(low, low[1:])), sum(map(len, words))
    mean = chars / n
    share = lambda found: (min(1, len(re.findall(found, text)) / max(1, chars))) ** 0.5
    return {
        "log_words": np.log1p(len(words)), "word_length": np.log1p(mean), "word_spread": np.log1p(max(0, sum(len(w) ** 2 for w in words) / n - mean * mean) ** 0.5),
        "symbols": share(rb"[#*$%&<>^~_={}\[\]\\@]"), "upper": share(rb"[A-Z]"), "digits": share(rb"[0-9]"), "marks": share(rb"[!?.,;:]"), "bars": share(rb"\|"),
        "distinct_words": len(set(low)) / n, "top_word": (max(Counter(low).values(), default=0) / n) ** 0.5, "distinct_pairs": len(set(pairs)) / max(1, len(words) - 1),
        "repeated_lines": 1 - max(1, len(set(lines))) / max(1, len(lines)), "line_words": np.log1p(len(words) / max(1, len(lines))),
        "unended_lines": sum(x.rstrip()[-1:] not in list(map(bytes, zip(b".!?:;\"'"))) for x in lines) / max(1, len(lines)),
    }


def test_quality_statistics_equal_a_plain_version():
    rng = random.Random(5)
    texts = ["", " \n\t ", "One", "A|b a|B #*$ 12 [x]\\ ^~\nEnd.\nEnd.\n\n", "é 中文 ½ É", "w" * 700_000 + " tail", " ".join(f"W{rng.randrange(900)}," for _ in range(120_000))]
    texts = [t.encode() for t in texts + ["".join(rng.choice("aB1 |.#\n\r") for _ in range(rng.randrange(90))) for _ in range(200)]]
    want = [[plain_statistics(t)[k] for k in quality_classifier.FEATURES] for t in texts]
    assert np.allclose(quality_classifier.statistics(texts), want, rtol=1e-9, atol=1e-6)
    assert np.array_equal(quality_classifier.statistics(texts), np.vstack([quality_classifier.statistics([t]) for t in texts]))


def test_words_hash_alike_in_any_block():
    rng = random.Random(6)
    words = [bytes(rng.choices(b"abCD", k=rng.choice((1, 3, 9, 40_000)))) for _ in range(400)] + [b"Z" * 600_000]
    at_once = Words([b" ".join(words)])
    assert len(at_once.bytes) > 3 * BLOCK and at_once.count.tolist() == [len(words)]
    for lower in (False, True):
        assert at_once.hashes(lower).tolist() == [int(Words([w]).hashes(lower)[0]) for w in words]
    assert Words([]).hashes().tolist() == Words([b"", b" "]).hashes().tolist() == []


def test_quality_model_equals_plain_gaussians(spark):
    rng = np.random.default_rng(4)
    d = len(quality_classifier.FEATURES)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * 0.3 + y[:, None]
    table = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x array<double>, y int").repartition(5)
    sums = quality_classifier.class_sums(table)
    for k in (0, 1):
        own = x[y == k]
        assert sums[k][0] == len(own) and np.allclose(sums[k][1], own.sum(0)) and np.allclose(sums[k][2], sum(np.outer(v, v) for v in own))
    covariance = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    both = sum((y == k).mean() * covariance[k] for k in (0, 1))
    log = []
    for k in (0, 1):
        s = 0.7 * covariance[k] + 0.3 * both
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        off = x - x[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(s), off))
    assert np.allclose(quality_classifier.Discriminant.fit(sums).score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_separates_and_takes_edge_cases(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) + (rng.choice("#*$%") * 3 if k % 2 else "") for _ in range(50))) for k in range(120)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(120)] + [(None, 1, 0), (3, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, [*docs, (500, None), (501, ""), (None, "x")])
    out = {r["doc_id"]: r for r in quality_classifier.score_quality(df, labels).collect()}
    assert all(out[k]["predicted"] == 1 - k % 2 for k in range(120)) and all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == 123
    assert {r["score"] for r in quality_classifier.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(df.limit(0), labels).count() == 0


def test_calls_are_linked_ordered_and_checked(spark):
    call = lambda *cs: chat_format.canonical({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    result = lambda i: chat_format.canonical({"tool_call_id": i, "content": "ok"})
    schema = chat_format.SCHEMAS | {"add": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    rows = [
        (1, 0, "system", "s"), (1, 1, "assistant", call(("a", "add", {"x": 1}), ("b", "add", {"x": {"$result": "a"}}))), (1, 2, "tool", result("b")), (1, 3, "tool", result("a")), (1, 4, "tool", result("zzz")),
        (1, 5, "assistant", call(("a", "add", {"x": True}))), (2, 1, "assistant", call(("p", "add", {"x": {"$result": "q"}}), ("q", "no", {"$result": "p"}))), (2, 2, "tool", result("p")), (2, 3, "tool", result("q")),
        (3, 0, "user", "é \"q\""), (3, 1, "assistant", "r"), (3, 2, "user", ""), (None, None, None, None), (4, 0, "assistant", "{\"tool_calls\": [1]}"),
    ]
    out = chat_format.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()
    got = {(r["conv_id"], r["turn"], r["part"]): (r["kind"], r["link"], r["level"], r["valid"]) for r in out}
    assert got[1, 1, 0] == ("call", "linked", 0, True) and got[1, 3, 0] == ("result", "linked", 1, None)
    assert got[1, 1, 1] == ("call", "linked", 2, False) and got[1, 2, 0] == ("result", "linked", 3, None)
    assert got[1, 4, 0][1] == "no call" and got[1, 5, 0][1] == "repeated" and got[1, 5, 0][3] is False
    assert got[2, 1, 0][1:3] == ("cycle", None) and got[2, 3, 0][1:3] == ("cycle", None)
    assert got[3, 0, 0] == ("call", "linked", 0, True) and got[3, 2, 0] == ("call", "no result", 0, False) and got[None, None, 0][0] == "message"
    assert next(r["body"] for r in out if (r["conv_id"], r["turn"]) == (3, 0)) == '{"content":"é \\"q\\"","role":"user"}'
    assert chat_format.link_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_odd_messages_are_kept(spark):
    deep = '{"tool_calls":[{"id":"d","name":"f","arguments":' + "[" * 1500 + "]" * 1500 + "}]}"
    texts = ['{"tool_calls":[{"id":"\\ud800","name":"f","arguments":{"x":{"$result":"\\ud800"}}}]}', deep, '{"tool_calls":[]}', '{"tool_calls":[{"id":"n","name":"f","arguments":[NaN]}]}', '{"tool_calls":[{"id":"i","name":"f","arguments":[1e999]}]}', '{"content":"hi","tool_calls":[{"id":"c","name":"f","arguments":{}}]}', "x" * 300_000]
    df = spark.createDataFrame([(1, 2 * k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "'mine' AS kind", "'mine' AS level", "1 AS node")
    out = {(r["turn"], r["part"]): r for r in chat_format.link_calls(clash).collect()}
    assert out[0, 0]["kind"] == "call" and out[0, 0]["call_id"] == "\\ud800" and "\\ud800" in out[0, 0]["body"]
    assert [out[t, 0]["kind"] for t in (2, 4, 6, 8, 10, 12)] == ["result", "result", "result", "result", "call", "result"]
    assert out[10, 1]["kind"] == "message" and out[10, 1]["body"] == '{"content":"hi","role":"assistant"}' and len(out) == 8
    assert all(out[t, 0]["body"] == chat_format.canonical({"content": texts[t // 2], "role": "assistant"}) for t in (2, 4, 6, 8, 12))


def test_long_chains_and_what_follows_a_cycle(spark):
    call = lambda i, *waits: chat_format.canonical({"tool_calls": [{"id": i, "name": "f", "arguments": [{"$result": w} for w in waits]}]})
    result = lambda i: chat_format.canonical({"tool_call_id": i, "content": "ok"})
    rows = [(1, 2 * k, "assistant", call(f"c{k}", *([f"c{k - 1}"] if k else []))) for k in range(36)] + [(1, 2 * k + 1, "tool", result(f"c{k}")) for k in range(36)]
    rows += [(2, 0, "assistant", call("p", "q")), (2, 1, "assistant", call("q", "p")), (2, 2, "assistant", call("s", "s")), (2, 3, "assistant", call("x", "q", "a")), (2, 4, "assistant", call("y", "x")), (2, 5, "assistant", call("a", "lone"))]
    rows += [(2, 10 + k, "tool", result(i)) for k, i in enumerate(["p", "q", "s", "x", "y", "a", "lone"])]
    out = chat_format.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["link"], r["level"]) for r in out}
    assert len(out) == len(rows) and all(got[1, t] == ("linked", t) for t in range(72))
    assert [got[2, t] for t in range(6)] == [("cycle", None)] * 3 + [("linked", None)] * 2 + [("linked", 1)]
    assert [got[2, 10 + t] for t in range(7)] == [("cycle", None)] * 3 + [("linked", None)] * 2 + [("linked", 2), ("no call", 0)]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    prose = [" ".join(f"w{(7 * k + j) % 997}" for j in range(60)) + "." for k in range(0, 400, 20)]
    docs = frame(spark, [(k, t) for k, t in enumerate([*prose, prose[0], "short", None])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out["doc_id"]) == [k for k in range(20) if k != 3]
    assert list(corpus_pipeline.dedup_stage(spark, docs, "").columns) == corpus_pipeline.COLUMNS


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{j}" for j in range(30)) for x in "abcd")
    rows = [(7, a), (7, a), (None, b), (None, b), (5, c), (6, c), (6, d), (None, a), (8, None), (8, None)]
    out = corpus_pipeline.dedup_stage(spark, frame(spark, rows), "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted([("7", a), ("None", b), ("5", c), ("6", d), ("8", "None"), ("8", "None")])
