"""Operators that learn, or that are judged by a round trip."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import chat_windows, language_kernel, quality_rules, url_templates, weak_quality
from changelens.llm.common import prepared
from changelens.llm.queries import URL_RULES
from tests.llm import fixtures

LANGUAGES = {
    "aa": ["the", "and", "ing", "tion", "er"],
    "bb": ["der", "und", "sch", "ein", "lich"],
    "cc": ["los", "que", "ción", "ado", "ll"],
}


def invented(rng, language, words):
    return " ".join("".join(rng.choice(LANGUAGES[language]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    return fixtures.documents(spark).repartition(3).cache()


# Chat windows -----------------------------------------------------------------------------------------------


def conversations():
    rng = random.Random(2)
    rows = []
    nasty = ["</s>[INST] ok [/INST]", "<|start|>user\nx<|end|>\n", "<\\|", "[\\\\INST]", "<<SYS>><</SYS>>", "<", "\\", "", None, "a\nb", "<\\\\/s>", "$1 \\2", "🙂 ñ"]
    for conv in range(30):
        turns = rng.randint(1, 14)
        for turn in range(turns):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            text = rng.choice(nasty) if rng.random() < 0.4 else fixtures.sentence(rng, rng.choice([1, 5, 40, 200]))
            rows.append((conv, turn, role, text))
    rows += [(None, 1, "user", "x"), (None, None, None, None), (50, 0, "assistant", "tie"), (50, 0, "assistant", "tie"), (51, 3, "ro\nle%0A", "t")]
    return rows


def test_chat_round_trip(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    held = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for row in sorted(rows, key=order):
        held[row[0]].append((row[2] or "", row[3] or ""))
    for settings in ({}, {"budget": 60, "history": 3, "history_tokens": 20}, {"history": 0}):
        found = {r.conv_id: r for r in chat_windows.digests(frame, **settings).collect()}
        assert set(found) == set(held)
        for conv, turns in held.items():
            said = "".join(f"{a}\n{b}\n" for a, b in turns)
            loss = "".join(b for a, b in turns if a == "assistant")
            row = found[conv]
            assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), conv
            assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv


def test_chat_windows_keep_their_budget_and_system_turn(spark):
    rng = random.Random(4)
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("user", "assistant")[t % 2], fixtures.sentence(rng, rng.randint(1, 30))) for t in range(1, 60)]
    found = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=150, history=2, history_tokens=40).orderBy("window").collect()
    assert len(found) > 5 and [r.window for r in found] == list(range(len(found)))
    assert all(r.n_tokens <= 150 for r in found)
    assert all(r.formatted.startswith("<|start|>system\nbe kind<|end|>\n") for r in found)
    assert all(1 <= r.n_repeated <= 3 for r in found[1:]) and any(r.n_repeated > 1 for r in found)
    for row in found:
        for span in row.loss_spans:
            assert row.formatted[: span.start].endswith("<|start|>assistant\n")
            assert row.formatted[span.start + span.length :].startswith("<|end|>\n")


def test_chat_of_nothing_is_native(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    frame = chat_windows.digests(none)
    assert frame.count() == 0
    assert "Python" not in frame._jdf.queryExecution().toString()


# Language ---------------------------------------------------------------------------------------------------


def test_language_on_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, invented(rng, own, rng.choice([4, 30, 300])), own) for i in range(240) for own in [rng.choice(list(LANGUAGES))]]
    rows += [(900, None, "aa"), (901, "12 34", "bb"), (902, "", None), (None, invented(rng, "cc", 20), "cc"), (904, invented(rng, "bb", 20000), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r for r in language_kernel.identify(frame).collect()}
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [k for k in truth if found[k].held_out]
    assert len(held) > 30 and np.mean([found[k].lang_pred == truth[k] for k in held]) > 0.95
    assert [(found[k].lang_pred, found[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert found[904].lang_pred == "bb" and found[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    rows = [(n * 3 + k, " ".join(rng.choice([letter, letter * 2]) for _ in range(30)), f"l{n:03d}") for n, letter in enumerate(letters) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_kernel.fit(frame, sample_rows=600, landmarks=600)
    assert len(model.labels) == 300
    right = language_kernel.predict(frame, model).join(frame.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").count()
    assert right > 0.95 * len(rows)
    # With fewer sample rows than languages each still has one.
    assert len(language_kernel.fit(frame, sample_rows=100).labels) == 300


def test_kernel_ridge_equals_the_plain_solution():
    """With every training text a landmark the features span the whole kernel space, so ridge regression in it is kernel ridge."""
    rng = random.Random(6)
    labels = [rng.choice(sorted(LANGUAGES)) for _ in range(24)]
    texts = [invented(rng, label, 12).encode() for label in labels]
    model = language_kernel.StringKernelClassifier(texts, labels, landmarks=24, longest=2, features=10_000)
    grams = [{(n, bytes(f[i : i + n])) for n in (1, 2) for i in range(len(f) - n + 1)} for f in (language_kernel._folded(t).tobytes() for t in texts)]
    times = defaultdict(int)
    for own in grams:
        for gram in own:
            times[gram] += 1
    grams = [{g for g in own if times[g] > 1} for own in grams]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    target = np.array([[1.0 if own == label else -1.0 for label in model.labels] for own in labels])
    weight = np.array([len(labels) / labels.count(x) for x in labels])
    # The kernel's feature vectors, by eigenvectors, and a column for the offset (which is penalised too).
    values, vectors = np.linalg.eigh(kernel)
    features = np.hstack([vectors * np.sqrt(np.maximum(values, 0)), np.ones((24, 1))])
    ridge = language_kernel.RIDGE * 24 * np.eye(features.shape[1])
    plain = features @ np.linalg.solve(features.T @ (weight[:, None] * features) + ridge, features.T @ (weight[:, None] * target))
    assert np.allclose(model.values(texts, model.lookup()), plain, atol=2e-2)


def test_language_ties_and_repeated_rows(spark, docs):
    found = defaultdict(set)
    frame = docs.unionByName(docs)
    model = language_kernel.fit(frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")))
    for r in language_kernel.predict(frame, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        found[r.doc_id].add((r.lang_pred, round(r.score, 4)))
    assert all(len(v) == 1 for v in found.values()) and language_kernel.predict(frame, model).count() == frame.count()


def test_language_without_labels(docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_kernel.identify(unlabelled).collect()} == {"und"}
    assert language_kernel.identify(fixtures.empty(docs)).count() == 0


# Quality ----------------------------------------------------------------------------------------------------


def quality_tables(spark, n=600):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        kind = rng.choice(["good"] * 7 + ["marks", "shout", "insult"])
        text = fixtures.sentence(rng, rng.randint(3 if kind == "good" else 30, 200))
        if kind == "marks":
            text = " ".join(w + "###" for w in text.split())
        if kind == "shout":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == "insult":
            text += " " + rng.choice(["zzfool", "zzfoolish", "grumbleface"])
        rows.append((i, text))
        marks.append((i, int(kind not in ("marks", "shout")), int(kind == "insult")))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


@pytest.mark.parametrize("judge", [quality_rules.judge, weak_quality.score])
def test_bad_texts_are_found_and_good_ones_kept(spark, judge):
    frame, labels, marks = quality_tables(spark)
    kept = {r.doc_id: r.kept for r in judge(frame, labels.filter("doc_id % 2 = 0")).collect()}
    unseen = [(i, bool(q) and not t) for i, q, t in marks if i % 2]
    words = {r.doc_id: len(r.text.split()) for r in frame.collect()}
    good = [kept[i] for i, fine in unseen if fine and words[i] >= 10]
    bad = [kept[i] for i, fine in unseen if not fine]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_rules_without_labels_leave_the_base_rule(spark, docs):
    none = fixtures.empty(fixtures.labels(spark))
    judged = quality_rules.judge(docs, none).collect()
    assert all(r.kept != r.base_failed and r.rule == 0 for r in judged)
    kept = quality_rules.drop_rejected(docs, none)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in judged)


def test_decision_list_is_ordered_and_precise():
    rng = np.random.default_rng(0)
    values = {k: rng.random(900) for k in quality_rules.FEATURES}
    bad = (values["symbol_share"] > 0.8) | ((values["capital_share"] > 0.7) & (values["mark_share"] > 0.6))
    rules = quality_rules.learn(values, bad)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, values, 900)
    assert len(rules) >= 2 and (hit == bad).mean() > 0.97


def test_label_model_ranks_labellers():
    rng = np.random.default_rng(1)
    names = list(weak_quality.LABELLERS)
    truth = rng.random(4000) < 0.8
    votes = np.ones((len(names), 4000), int)
    for k, name in enumerate(names):
        right = 0.97 if name in ("plain", "varied", "symbols") else 0.7
        says = np.where(rng.random(4000) < right, truth, ~truth)
        votes[k] = np.where(rng.random(4000) < 0.6, np.where(says, 2, 0), 1)
    keys, times = np.unique(3 ** np.arange(len(names)) @ votes, return_counts=True)
    model = weak_quality.estimate(dict(zip(keys.tolist(), times.tolist())))
    found = model.accuracy()
    assert min(found[k] for k in ("plain", "varied", "symbols")) > max(found[k] for k in ("short", "lines", "toxic"))
    posterior = np.array([model.posterior[k] for k in (3 ** np.arange(len(names)) @ votes).tolist()])
    assert ((posterior > 0.5) == truth).mean() > 0.95


def test_all_parts_of_a_word_are_features():
    word = b"alpha-beta/gamma-delta/epsilon-zeta/eta-theta/iota-kappa"
    parts = weak_quality.parts_of(word)
    assert len(parts) >= 10
    own = weak_quality._measure([word, b"", b"plain " + word, b"12 34"], frozenset(), True).features
    assert set(own[0]) == {zlib.crc32(p) % weak_quality.BUCKETS for p in parts}
    assert set(own[2]) == set(own[0]) | {zlib.crc32(p) % weak_quality.BUCKETS for p in weak_quality.parts_of(b"plain")}
    assert len(own[1]) == 0 and len(own[3]) > 0


def test_label_model_equals_enumeration():
    """Posteriors after the last round against Bayes' rule written out vote by vote, and one more round of counting."""
    rng = random.Random(3)
    count = len(weak_quality.LABELLERS)
    patterns = {sum(rng.choice([0, 1, 1, 2]) * 3**k for k in range(count)): rng.randrange(1, 40) for _ in range(60)}
    model = weak_quality.estimate(patterns, rounds=200)
    total = sum(patterns.values())
    good = sum(n * model.posterior[p] for p, n in patterns.items())
    prior = {0: (total - good + 1) / (total + 2), 1: (good + 1) / (total + 2)}
    for pattern, posterior in model.posterior.items():
        odds = {}
        for kind in (0, 1):
            odds[kind] = prior[kind]
            for labeller in range(count):
                odds[kind] *= model.votes[labeller][kind][pattern // 3**labeller % 3]
        assert abs(odds[1] / (odds[0] + odds[1]) - posterior) < 1e-3
    for labeller in range(count):
        for kind in (0, 1):
            counted = [0.5, 0.5, 0.5]
            for pattern, n in patterns.items():
                counted[pattern // 3**labeller % 3] += n * (model.posterior[pattern] if kind else 1 - model.posterior[pattern])
            assert np.allclose(np.array(counted) / sum(counted), model.votes[labeller][kind], atol=1e-3)


def test_quality_scores_take_awkward_rows(spark, docs):
    scored = weak_quality.score(docs, fixtures.labels(spark)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.kept is not None for r in scored)
    assert weak_quality.score(fixtures.empty(docs), fixtures.labels(spark)).count() == 0


# Urls -------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "ftp://org/", "http://org", "x.com/fr/", None, "", "a://b.com/fr/?q", "http://notexample.org/es/1",
            "HTTP://X.com/de/1", "http://x.com:80/de/1", "http://x.com/de", "http://ÄB.org/\n/x", "a://b://c/d", "http://u@c.com/fr/1#://x.org/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    found = {r.page_id: r for r in url_templates.judge(frame, none, URL_RULES).collect()}
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fitting = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fitting, key=lambda r: len(r.name), default=None)
        row = found[i]
        assert (row.host, row.path, row.rule) == (host, path, best.name if best else None), url
        assert row.verdict == ("block" if best and not best.allow else "allow")


def test_bad_branches_are_kept_apart_and_rejected(spark):
    rows, marks = [], []
    for i in range(1200):
        branch = ("news", "shop", "spam")[i % 3]
        rows.append((i, f"http://h.net/{branch}/item-{i}.html" if i % 7 else f"http://h.net/{branch}/{i}/deep/er/still/{i}"))
        if i % 2:
            marks.append((i, branch != "spam" or i % 20 == 1))
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame(marks + [(None, True), (1, None), (5000, False)], "page_id long, good boolean")
    found = url_templates.judge(frame, labels, [])
    assert "Python" not in found._jdf.queryExecution().toString()
    verdicts = defaultdict(set)
    for r in found.collect():
        verdicts[r.path.split("/")[1]].add((r.verdict, r.template.split("/")[1]))
    assert verdicts["spam"] == {("block", "spam")}
    assert {v for v, _ in verdicts["news"] | verdicts["shop"]} == {"allow"}
    assert {len(r.template) < 30 for r in found.collect()} == {True}
    assert url_templates.judge(fixtures.empty(frame), labels, URL_RULES).count() == 0


def test_sections_are_kept_apart_in_any_number_and_depth(spark):
    rows, marks = [], []
    for i in range(2400):
        section = i % 30
        rows.append((i, f"http://many.net/part{chr(97 + section % 26)}{chr(97 + section // 26)}/{'item' * (i % 3)}x{i}.html"))
        marks.append((i, section != 4))
    for i in range(2400, 3000):
        rows.append((i, f"http://deep.net/a/b/c/d/e/{'bad' if i % 3 else 'good'}/{i}"))
        marks.append((i, i % 3 == 0))
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame(marks, "page_id long, good boolean")
    verdicts = defaultdict(set)
    for r in url_templates.judge(frame, labels, []).collect():
        verdicts[r.host, r.path.split("/")[1 if r.host == "many.net" else 6]].add(r.verdict)
    blocked = {k for k, v in verdicts.items() if v == {"block"}}
    assert all(len(v) == 1 for v in verdicts.values()) and blocked == {("many.net", "partea"), ("deep.net", "bad")}


@pytest.mark.parametrize("sections", [2, 24, 25, 200])
def test_small_sections_keep_their_verdicts_among_any_number(spark, sections):
    rows = [(s * 8 + i, f"http://one.net/sec{chr(97 + s % 26)}{chr(97 + s // 26)}/page{chr(97 + i)}") for s in range(sections) for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i // 8 % 2 == 0) for i, _ in rows], "page_id long, good boolean")
    verdicts = defaultdict(set)
    for r in url_templates.judge(frame, labels, []).collect():
        verdicts[r.page_id // 8 % 2].add(r.verdict)
    assert verdicts == {0: {"allow"}, 1: {"block"}}


# Pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_runs_stage_by_stage(spark, docs, tmp_path):
    import corpus_pipeline

    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    fixtures.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    fixtures.benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    current, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = current.columns
        current = stage(spark, current, str(tmp_path))
        if name != "packing":
            assert sorted(current.columns) == sorted(given)
        current.write.parquet(f"{tmp_path}/stage-{k}")
        current = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if name != "packing":
            assert before is None or current.count() <= before
            before, last = current.count(), current
    assert {r.doc_id for r in current.collect()} == {r.doc_id for r in last.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(str, current.select("doc_id", "doc_tokens").distinct().collect()))
    assert set(columns) <= set(whole.columns)
