"""Operators 1, 7, 9 and 10, and the pipeline, on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import chat, quality, toxicity, urls
from ragloom.llm.queries import ORACLE_SQL, QUERIES
from ragloom.llm.quality import score_quality
from ragloom.llm.toxicity import Grammar, score_toxicity


def corpus(n: int = 400):
    """Documents with labels: insults of an own stem are toxic, lines of repeats are poor."""
    rng = random.Random(1)
    syllables = "an en ti on re th in er ha st".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            for k in range(0, len(words), 9):
                words[k] = "grobo" + word()
        if poor:
            words = [w for w in words for _ in range(4)]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "fine word " * 30000), (None, "fine"), (3, docs[3][1])]
    labels += [(None, 1, 1), (n, None, None), (3, 1, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(i, t, 0.0, 1) for i, t in docs], "doc_id long, text string, score double, label int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "held", "folds"), [(score_toxicity, "toxic", 2, 4), (score_quality, "quality", 0, 5)])
def test_held_out_accuracy(tables, operator, label, held, folds):
    docs, labels = tables
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] is not None and r[label] is not None}
    tested = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert {r["held_out"] for r in rows if r["doc_id"] is not None} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.93 * len(tested)
    assert operator(docs.limit(0), labels).collect() == []
    assert len(operator(docs.limit(5), labels.limit(0)).collect()) == 5


IDIOTS = {"grob*": toxicity.INSULT, "idiot": toxicity.INSULT, "moron": toxicity.INSULT, "silly": toxicity.SLUR}


def test_grammar_scores_clauses():
    g = Grammar(IDIOTS)
    found = lambda text: [toxicity.OUTPUTS[k] for k in g.clauses(text)]
    assert found("You are an idiot.") == [("insult", "t")]
    assert found("He is not an idiot. Idiot!") == [("insult", "tn"), ("insult", "")]
    assert found("Such an idiot, you know") == [("insult", "t")]
    assert found("Silly idiot, moron. They said: grobian") == [("insults", ""), ("insult", "")]
    assert found("Someone called me a moron, really") == [("insult", "r")]
    assert found("I will kill you. Ich werde dich töten! Kill them") == [("threat", "t"), ("threat", "t"), ("command", "t")]
    assert found("I will not hurt you") == [("threat", "tn")]
    assert found('"I will kill you" is a line') == [("threat", "tr")]
    assert found("They kill time. We will see you. 123") == [] and found(None) == found("") == []
    w = dict(zip(toxicity.OUTPUTS, toxicity.prior_weights(), strict=False))
    assert w["insult", "t"] > w["insult", ""] > w["insult", "r"] > w["insult", "nr"]
    # Clauses score, not words: many negated insults stay below one that isn't.
    score = lambda text: toxicity.score(toxicity.prior_weights(), g.features(text))
    assert score("Not an idiot. " * 3) < score("An idiot.") < toxicity.THRESHOLD <= score("You are an idiot.")
    assert score("They kill time and destroy things. " * 50) == score("")


def test_composed_automaton_equals_a_walk_of_its_transducers():
    rng = random.Random(4)
    words = {toxicity.OTHER: "thing", toxicity.INSULT: "idiot", toxicity.SLUR: "silly", toxicity.VIOLENT: "kill", toxicity.SPEAKER: "we", toxicity.MODAL: "will", toxicity.TARGET: "you", toxicity.NEGATOR: "not", toxicity.SPEECH: "said", toxicity.QUOTE: '"', toxicity.END: "."}
    g, parts = Grammar(IDIOTS), [make() for make in toxicity.CASCADE]
    weights = toxicity.prior_weights()
    matched = 0
    for _ in range(1500):
        read = rng.choices(range(11), k=rng.randint(1, 25))
        states, want, own = [p.start for p in parts], [], []
        for symbol in read:
            cell = (symbol, "", "")
            for i, part in enumerate(parts):
                states[i], cell = part.step(states[i], cell)
            if cell[1]:
                own.append(toxicity.OUTPUTS.index(cell[1:]))
            if symbol == toxicity.END:
                want, own = [*want, *([max(own, key=lambda k: weights[k])] if own else [])], []
        want += [max(own, key=lambda k: weights[k])] if own else []
        assert [weights[k] for k in g.clauses(" ".join(words[x] for x in read))] == [weights[k] for k in want]
        matched += len(want)
    assert matched > 1000


@pytest.mark.parametrize(("left_out", "text"), [(toxicity.negation, "You are not an idiot."), (toxicity.reported, "She said you are an idiot."), (toxicity.target, "You are an idiot."), (toxicity.insult, "You are an idiot."), (toxicity.threat, "We will kill them.")])
def test_each_transducer_decides(left_out, text):
    predicted = lambda g: toxicity.score(toxicity.prior_weights(), g.features(text)) >= toxicity.THRESHOLD
    whole, part = Grammar(IDIOTS), Grammar(IDIOTS, [make for make in toxicity.CASCADE if make is not left_out])
    assert predicted(whole) != predicted(part)


def test_training_rows_are_bounded_and_one_an_id(spark):
    docs, labels = corpus(120)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seven = table
    for _ in range(6):
        seven = seven.union(table)
    rows = lambda t, most, **k: sorted(tuple(r) for r in quality.training_rows(t, marks, "toxic", 2, 4, most, **k).collect())
    assert rows(seven, 40) == rows(table, 40) and len(rows(seven, 40)) == 40
    assert np.array_equal(quality.learn_weights(quality.training_rows(seven, marks, "quality", 0, 5, 50)), quality.learn_weights(quality.training_rows(table, marks, "quality", 0, 5, 50)))
    few = rows(seven, 40, chars=3000)
    assert set(few) < set(rows(seven, 40)) and 2000 < sum(len(t or "") for _, t, _ in few) <= 3000
    assert rows(table.limit(0), 40) == []


def test_ftrl_equals_a_dense_restatement():
    texts = ["good calm words here", "bad bad bad bad", "calm words, again here", "noise noise noise 99", None, "good words"]
    labels = [1, 0, 1, 0, 0, 1]
    size = quality.BUCKETS + quality.SHAPES**3
    f = quality.Features()
    rows = []
    for t in texts:
        at = f(t)
        x = np.zeros(size + 1)
        for i in at:
            x[i] += 8.0 / len(at)
        x[size] = 1.0
        rows.append(x)
    used = np.flatnonzero(np.any(rows, axis=0))
    z, n = dict.fromkeys(used.tolist(), 0.0), dict.fromkeys(used.tolist(), 0.0)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for r in order.permutation(len(rows)):
            w = {i: weight(i) for i in z}
            p = 1 / (1 + math.exp(-sum(w[i] * rows[r][i] for i in z)))
            for i in z:
                if rows[r][i]:
                    g = (p - labels[r]) * rows[r][i]
                    sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                    z[i] += g - sigma * w[i]
                    n[i] += g * g
    got = quality.train(texts, labels)
    assert np.allclose(got[used], [weight(i) for i in used.tolist()], atol=1e-6) and np.count_nonzero(got) == sum(weight(i) != 0 for i in used.tolist())
    assert quality.score(f, got, texts[0]) == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * rows[0][i] for i in used.tolist()))), abs=1e-5)


def test_chat_reads_back(spark):
    rng = random.Random(2)
    parts = ["word ", "</s>", "[INST]", "<|end|>\n", "<|turn|>", "\\", "\\|", "\n", "é", "<", "|"]
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 == 0 else "assistant", "".join(rng.choices(parts, k=rng.randint(0, 12)))) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", ""), (50, 1, "assistant", ""), (None, None, None, "x")]
    rows += [(51, t, "assistant" if t % 2 else "us\\er\n", "long text here " * 150) for t in range(8)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_conversations(turns, budget=500, history=200)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        turns_ = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(turns_.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[51]["n_windows"] > 1
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_windows_keep_budget_and_system():
    w = chat.Windows(budget=10, history=4)
    made = []
    for i, n in enumerate([2, 3, 3, 3, 2, 30, 1]):
        made += list(w.add(chat.Turn("system" if i == 0 else "assistant" if i % 2 else "user", f"t{i}", n)))
    made += list(w.end())
    assert all(x.tokens <= 10 or x.formatted.count(chat.OPEN) - x.repeated == 1 for x in made)
    assert all("system\nt0" in x.formatted for x in made)
    spans = [x.formatted[s["start"] : s["end"]] for x in made for s in x.loss]
    assert spans == ["t1", "t3", "t5"]
    assert any(x.repeated > 1 for x in made)


PAGES = [(1, "http://A.com/en/x?y"), (2, "https://b.example.com/en/71#z"), (3, "http://x.net/de/9"), (4, "http://q.example.net/de/8a"), (5, "ftp://com"), (6, None), (7, "no scheme/en/"), (8, "http://dot.org/es/"), (9, "http://notexample.com/en"), (10, "http:///en/"), (10, "http:///en/")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in PAGES], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect()}
    assert got == {
        1: ("a.com", "/en/x", "com/en/", "block"), 2: ("b.example.com", "/en/71", "example.com/en/7", "allow"), 3: ("x.net", "/de/9", "net/de/", "allow"), 4: ("q.example.net", "/de/8a", "example.net/de/8", "block"),
        5: ("com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("dot.org", "/es/", "org/es/", "block"), 9: ("notexample.com", "/en", None, "allow"), 10: ("", "/en/", None, "allow"),
    }
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_templates_generalise_and_reject(spark):
    rows = [(i, f"http://h.test/shop/{i}/view") for i in range(40)] + [(100 + i, f"http://h.test/blog/{'abcdefghijklmnopqrstuvwxyzABCDEFGHIJ'[i]}") for i in range(36)] + [(200, "http://h.test/a/b/c/d/e/f")]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(36)] + [(None, 1), (200, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, spark.createDataFrame(labels, "id long, bad int")).collect()}
    assert got[3]["template"] == "/shop/*/view" and got[3]["verdict"] == "block"
    assert got[110]["template"] == "/blog/*" and got[110]["verdict"] == "allow"
    assert got[200]["template"] == "/a/b/c/d/**"


def test_long_paths_are_told_apart_by_their_labels(spark):
    kinds = ("ads", "story")
    rows = [(100 * k + i, f"http://h.test/x/y/news/local/region/{kind}/{i}") for k, kind in enumerate(kinds) for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "id long, bad int")
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert {got[i]["verdict"] for i in range(20)} == {"block"} and {got[100 + i]["verdict"] for i in range(20)} == {"allow"}
    assert got[0]["template"] == "/x/y/news/local/region/ads/**"


def test_similar_branches_are_merged_at_every_level(spark):
    rows = [(100 * b + i, f"http://{host}/{lang}/{i}") for b, (host, lang) in enumerate([("h.test", "en"), ("h.test", "fr"), ("g.test", "en"), ("g.test", "fr")]) for i in range(20)]
    bad = lambda i: int(i // 100 == 2 or i // 100 < 2 and i % 4 == 0)
    labels = spark.createDataFrame([(i, bad(i)) for i, _ in rows], "id long, bad int")
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    prior = 30 / 80
    assert got[0]["template"] == "/en/*" and got[100]["template"] == "/fr/*"
    assert got[0]["purity"] == got[100]["purity"] == round((10 + 4 * prior) / 44, 6)
    assert (got[200]["verdict"], got[300]["verdict"]) == ("block", "allow") and got[200]["purity"] == round((20 + 4 * prior) / 24, 6)


def test_templates_equal_sql_on_random_trees(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(30)
    hosts = ["a.test", "b.test", "shop.example.com", "x.net"]
    rows, labels = [], []
    for i in range(1500):
        parts = [rng.choice(["en", "fr", "de", "es", f"s{rng.randrange(60)}" if rng.random() < 0.3 else chr(97 + rng.randrange(26)) * rng.randint(1, 3)]) for _ in range(rng.randint(0, 4))]
        host = rng.choice(hosts)
        rows.append((i, f"https://{host}/{'/'.join(parts)}{rng.choice(['', '/', '?q=1', '#x'])}"))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() > (0.7 if parts[:1] == ["fr"] and host == "a.test" else 0.1))))
    rows += [(None, "https://a.test/en/7"), (7, "https://A.test/fr/x"), (7, "https://A.test/fr/x"), (2000, None), (2001, "https://x.net/de/" + "long" * 5000)]
    labels += [(None, 0), (3, None), (3, 0), (3, 1)]
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    c.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype({"doc_id": "Int64", "quality": "Int64"}))
    want = c.execute(f"SELECT page_id, host, path, rule, verdict, template, purity FROM ({urls.oracle_sql()})").fetchall()
    marks = spark.createDataFrame(labels, "id long, quality int").select("id", (1 - F.col("quality")).alias("bad"))
    got = [tuple(r) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), marks).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == len(rows)
    by_method = [r for r in got if r[3] is None]
    assert 0 < sum(r[4] == "block" for r in by_method) < len(by_method) / 3


def test_pipeline_stages(spark, tables, tmp_path):
    import corpus_pipeline

    docs, labels = tables
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "simhash", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("toxicity", "quality", "simhash"):
        out = stages[name](spark, now, str(tmp_path))
        assert out.schema == now.schema and 0 < out.count() < now.count() + (name == "quality")
        now = out
    assert {r["doc_id"] for r in now.select("doc_id").collect() if r["doc_id"] and r["doc_id"] % 5 == 0 and r["doc_id"] < 400} == set()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert stages["packing"](spark, now.limit(0), str(tmp_path)).count() == 0


def test_pipeline_drops_planted_near_copies(spark, tmp_path):
    import corpus_pipeline
    from ragloom.llm.simhash import fingerprint

    rng = random.Random(16)
    rows, far = [], 0
    for i in range(30):
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        near, other = list(words), list(words)
        near[10 + i] = near[80] = "changed"  # ten of 116 shingles differ: similarity 106 / 126
        for k in range(0, 120, 20):
            other[k] = "changed"  # 26 shingles differ: 90 / 142
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(other))]
        far += (fingerprint(rows[-3][1]) ^ fingerprint(rows[-2][1])).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, str(tmp_path)).collect()}
    assert far > 20 and got == {i for i in range(90) if i % 3 != 1}


def test_pipeline_keeps_one_row_of_a_component_whatever_its_ids(spark, tmp_path):
    import corpus_pipeline

    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    rows = [(None, text[0], "x"), (None, text[0].upper(), "y"), (None, text[0], "x")]  # no id at all
    rows += [(3, text[1], "x"), (3, text[2], "x"), (2, text[2], "y")]  # an id in two components
    rows += [(5, text[3], "x"), (5, text[3], "x"), (None, text[3], "x")]  # equal rows
    docs = spark.createDataFrame([*rows, (None, text[4], "x")], "doc_id long, text string, source string")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, str(tmp_path)).collect()]
    assert sorted((r[1][0].lower(), r[0]) for r in got) == [("a", None), ("b", 3), ("c", 2), ("d", 5), ("e", None)]


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
