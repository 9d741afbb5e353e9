"""The operators' defined cases, and brute force for what SQL cannot express."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import chat_trees, decontaminate, domain_mixing, language_id, line_dedup, line_quality, ngram_join, pseudonyms, queries, secret_scan, url_trust

EN, DE = "the house and that was of this with from", "der die und nicht das ist mit auch noch"


def say(rng, words, n):
    return " ".join(rng.choice(words.split()) for _ in range(n))


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(secret_scan.labelled_findings(spark))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like those in use within."""
    long = "word. " * 60_000
    rows = [(1, "A plain text, of one line.", "a"), (1, "A plain text, of one line.", "a"), (None, "A plain text, of one line.", "b"), (2, None, "c"), (3, "", None), (4, long, "d"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    return df.selectExpr("*", *(f"row as `{c}`" for c in ("match", "parts", "found", "named", "stats", "ranges", "items", "n", "hit", "__match", "__text", "__drop", "drop", "a.b")))


@pytest.mark.parametrize("name", ["language", "secrets", "quality", "decontamination", "pii", "lines"])
def test_rows_and_columns_survive(spark, odd, forest, name):
    bench = spark.createDataFrame([("i", "A plain text of one line")], "item_id string, text string")
    run = {
        "language": lambda d: language_id.label_languages(d, language_id.train(d.withColumn("lang", F.lit("en")))),
        "secrets": lambda d: secret_scan.scan_secrets(d, forest),
        "quality": line_quality.clean_lines,
        "decontamination": lambda d: decontaminate.find_contamination(d, bench),
        "pii": lambda d: pseudonyms.pseudonymise(d, "k"),
        "lines": line_dedup.dedup_lines,
    }[name]
    out = run(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    others = [c for c in odd.columns if c != "text"]
    key = lambda r: tuple(str(r[c]) for c in others)
    assert sorted(map(key, out.collect())) == sorted(map(key, odd.collect()))
    assert run(odd.where("false")).count() == 0


def test_joins_and_mixing_of_odd_rows(spark, odd):
    assert ngram_join.similar_components(odd).count() == 7 and ngram_join.keep_one_of_each(odd).columns == odd.columns
    assert ngram_join.keep_one_of_each(odd).count() == 5
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    mixed = domain_mixing.mix(odd, labels, keep=("doc_id", "row", "drop"))
    assert mixed.count() == 7 and mixed.columns[:3] == ["doc_id", "row", "drop"]


# Language ID ---------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 3, 0, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(scale=3, size=(first[-1], 3)).astype(np.float32)
    labels = language_id.viterbi(scores, first, 2.0)
    cost = lambda s, path: sum(float(s[i, k]) for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for i, j in zip(first[:-1], first[1:]):
        s = scores[i:j]
        if i < j:
            best = max(cost(s, p) for p in itertools.product(range(3), repeat=j - i))
            assert cost(s, labels[i:j].tolist()) == pytest.approx(best, abs=1e-4)


def test_many_languages():
    scores = np.full((4, 300), -5.0, dtype=np.float32)
    scores[:, 299] = 0
    assert language_id.viterbi(scores, np.array([0, 4]), 1.0).tolist() == [299] * 4


def test_op3_on_a_small_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, say(rng, EN if i % 2 else DE, 25), ["de", "en"][i % 2]) for i in range(80)] + [(100, None, "en"), (101, "12 34", "en"), (102, say(rng, DE, 30), None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_language_id(spark, str(tmp_path)).collect()}
    assert {i: (r.held_out, r.lang_pred) for i, r in got.items()} == {i: (zlib.crc32(str(i).encode()) % 4 == 2, {100: "und", 101: "und", 102: "de"}.get(i, lang)) for i, _, lang in rows}
    assert all(0 <= r.score <= 1 for r in got.values())


# Secrets -------------------------------------------------------------------------------


def test_forest_as_expression_is_the_forest(spark, forest):
    rows = secret_scan.labelled_findings(spark, 400).select(forest.features(F.col("before"), F.col("value"), F.col("after")).alias("x")).select("x", forest.score(F.col("x")).alias("score")).collect()

    def walk(node, x):
        return node if isinstance(node, float) else walk(node[2] if x[node[0]] <= node[1] else node[3], x)

    for r in rows:
        assert r.score == pytest.approx(sum(walk(t, r.x) for t in forest.trees) / len(forest.trees))


def test_secrets_held_out(spark):
    seen, unseen = secret_scan.split_findings(secret_scan.labelled_findings(spark))
    precision, recall = secret_scan.measure(unseen, secret_scan.train(seen))
    assert precision > 0.97 and recall > 0.97


def test_dictionary_comes_from_the_table(spark):
    docs = spark.createDataFrame([("zebra quilt " * 20,), (None,)], "text string")
    labelled = spark.createDataFrame([("x", "marmalade_2024_value", "", False)] * 3 + [("t", None, "", True), ("t = ", "a1B2c3D4e5", "", True)], "before string, value string, after string, is_secret boolean")
    learned = secret_scan.learn(labelled, docs)
    assert set(learned.words) == {"zebra", "quilt", "marmalade", "value"} and dict(learned.steps)["f0"] > 0 > dict(learned.steps)["zz"]


def test_op4_on_a_small_table(spark, tmp_path):
    key = hashlib.sha1(b"q").hexdigest()
    rows = [(1, f'say token = "{key}" and more'), (2, f"commit {key}"), (3, None), (4, f"password={key}\npassword={key}"), (5, "long_identifier_name_2024_of_a_file")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_candidates, r.starts) for r in queries.op4_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (1, [13]), 2: (1, []), 3: (0, []), 4: (2, [9, 59]), 5: (1, [])}


# Quality -------------------------------------------------------------------------------


def test_runs_of_spaces_are_no_words(spark):
    text = "ab            cd ef\nOne line of text, and some more of it.\ttabs\tare\there."
    r = line_quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.clean_text == text


def test_quality_verdict(spark):
    good, bad = "A plain sentence of some more words, it ends well enough.", "a " * 40
    rows = [(1, f"{good}\n{bad}"), (2, f"{good}\nHome | About | Contact | Help | More | Items | Of | A | Long | Menu | Bar | Here"), (3, good)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in line_quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True)}


# Pseudonyms ----------------------------------------------------------------------------


def plain_permutation(digits, key):
    left = len(digits) // 2
    a, b, size_a, size_b = int(digits[:left]), int(digits[left:]), 10**left, 10 ** (len(digits) - left)
    number = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    for i in range(pseudonyms.ROUNDS):
        if i % 2 == 0:
            a = (a + number(key, i, size_a, b) % size_a) % size_a
        else:
            b = (b + number(key, i, size_b, a) % size_b) % size_b
    return str(a).zfill(left) + str(b).zfill(len(digits) - left)


def test_feistel_against_plain_python(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(2, 19))) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in rows], "d string").select("d", pseudonyms.permute_digits(F.col("d"), "k").alias("e")).collect()
    assert all(r.e == plain_permutation(r.d, "k") for r in got)


def test_numbers_are_permuted_among_valid_ones(spark):
    rng = random.Random(6)
    ssn = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(400)})
    phones = sorted({f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}" for _ in range(100)} | {f"0{rng.randrange(100, 999)} {rng.randrange(1000000, 9999999)}" for _ in range(100)})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ssn + phones)], "doc_id long, text string")
    got = pseudonyms.pseudonymise(rows, "k").select("doc_id", "text", F.get("values", 0).kind.alias("kind")).collect()
    assert len({r.text for r in got}) == len(got) == len(rows.collect()) and {r.kind for r in got} == {"ssn", "phone"}
    new = spark.createDataFrame([(r.doc_id, r.text, r.kind) for r in got], "doc_id long, text string, was string")
    again = pseudonyms.pseudonymise(new, "k").select("was", F.size("values").alias("n"), F.get("values", 0).kind.alias("kind")).collect()
    assert all((r.n, r.kind) == (1, r.was) for r in again)
    back = {r.doc_id: r.old for r in new.select("doc_id", pseudonyms.original_number(F.col("text"), F.col("was"), "k").alias("old")).collect()}
    assert [back[i] for i in range(len(back))] == ssn + phones


def test_mail_names_do_not_collide(spark):
    rows = [(i, f"{c}@x.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(30, "l" * 60 + "@x.org")]
    assert len({r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}) == 27


def test_op8_on_a_small_table(spark, tmp_path):
    rows = [(1, "call 555-123-4567 now"), (2, "555-123-4567, 4111111111111111"), (3, None), (4, "nothing 12")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_pii_pseudonyms(spark, str(tmp_path)).collect()}
    new, body = plain_permutation("5551234567", queries.PII_KEY + "number"), plain_permutation("411111111111111", queries.PII_KEY + "card")
    phone = f"{new[:3]}-{new[3:6]}-{new[6:]}"
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10
    card = next(body + str(c) for c in range(10) if luhn(body + str(c)) == 0)
    assert [got[i].text for i in (1, 2, 3, 4)] == [f"call {phone} now", f"{phone}, {card}", None, "nothing 12"]
    assert {i: [(v.start, v.length, v.kind) for v in r["values"]] for i, r in got.items()} == {1: [(5, 12, "phone")], 2: [(0, 12, "phone"), (14, 16, "card")], 3: [], 4: []}


# Mixing --------------------------------------------------------------------------------


def test_op6_totals_are_targets_and_residuals(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["good fine words here", "poor stuff there now", "vile slurs shout loud", "crude hate yell mad"]
    of = [rng.choices(range(4), [0.5, 0.4, 0.06, 0.04])[0] for _ in range(400)]
    spark.createDataFrame([(i, say(rng, kinds[k], 30)) for i, k in enumerate(of)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(k in (0, 2)), int(k > 1)) for i, k in enumerate(of)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op6_domain_mixing(spark, str(tmp_path)).collect()
    p, t, rate = (np.array([r[c] for r in rows]) for c in ("posteriors", "n_tokens", "rate"))
    weights = np.array([domain_mixing.TARGETS[d] for d in rows[0].domains])
    present = p.T @ t
    budget = max(t.sum(), present[weights.argmax()] / weights.max())
    assert np.allclose(p.T @ (t * rate), weights * budget + np.array(rows[0].residuals), atol=1e-6 * budget)
    assert np.abs(rows[0].residuals).sum() <= 2 * domain_mixing.TOLERANCE * budget and (rate >= 0).all()
    assert domain_mixing.accuracy(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels) > 0.95


# Chat ----------------------------------------------------------------------------------


def test_replies_to_a_cycle_have_no_path(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "c", 9.0), (1, 4, None, "user", "d", 0.0), (1, 5, 4, "assistant", "e", None), (1, 6, 6, "user", "f", 0.0), (1, 7, 3, "user", "g", 0.0)]
    found = chat_trees.format_paths(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), best=9).collect()
    assert [(r.leaf, r.n_turns) for r in found] == [(5, 2)]


def test_branches_of_a_random_tree(spark):
    rng = random.Random(12)
    rows = [(i // 30, i, None if i % 30 == 0 else rng.randrange(i - i % 30, i), "user", str(i), rng.random()) for i in range(90)]
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[5] for r in rows}

    def path(i):
        return [] if i is None else [*path(parent[i]), i]

    want = {}
    for tree in range(3):
        leaves = [i for i in parent if i // 30 == tree and i not in parent.values()]
        mean = {i: sum(score[x] for x in path(i)) / len(path(i)) for i in leaves}
        want |= {(tree, k + 1): path(i) for k, i in enumerate(sorted(leaves, key=lambda i: (-mean[i], i))[:4])}
    found = chat_trees.format_paths(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), best=4)
    got = {(r.tree, r.branch_rank): [int(t.text) for t in r.turns] for r in found.select("tree", "branch_rank", chat_trees.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == want


def test_chat_without_rows(spark):
    assert chat_trees.format_paths(chat_trees.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# URLs ----------------------------------------------------------------------------------


def test_ranks_against_dense_pagerank(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.{['org', 'com', 'net'][i % 3]}" for i in range(12)]
    links = [[rng.choice(hosts) for _ in range(rng.randrange(4))] for _ in range(40)]
    pages = [(i, f"http://{rng.choice(hosts)}/p", "".join(f'<a href="http://{x}/">t</a>' for x in links[i])) for i in range(40)]
    at = {h: k for k, h in enumerate(hosts)}
    edge, seeds = np.zeros((12, 12)), {"allow": np.zeros(12), "block": np.zeros(12)}
    for i, url, _ in pages:
        h = url.split("/")[2]
        for x in set(links[i]) - {h}:
            edge[at[h], at[x]] += 1
        if not h.endswith("net"):
            seeds["allow" if h.endswith("org") else "block"][at[h]] += 1
    ranks = {}
    for kind, m in (("allow", edge), ("block", edge.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        ranks[kind] = np.linalg.solve(np.eye(12) - 0.85 * share.T, 0.15 * seeds[kind] / seeds[kind].sum())
    rules = [url_trust.Rule("allow", "org", "/"), url_trust.Rule("block", "com", "/")]
    for r in url_trust.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect():
        k = at[r.host]
        assert (r.trust, r.distrust) == (pytest.approx(ranks["allow"][k], abs=1e-7), pytest.approx(ranks["block"][k], abs=1e-7))
        said = {"org": "allow", "com": "block"}.get(r.host[-3:], "block" if ranks["block"][k] > ranks["allow"][k] else "allow")
        assert r.verdict == said


def test_many_rules_and_ties(spark):
    rules = [url_trust.Rule(["allow", "block"][i % 2], f"h{i}.org", f"/p{i}") for i in range(700)]
    rules += [url_trust.Rule("allow", "h1.org", "/p1"), url_trust.Rule("allow", "org", "/aaa"), url_trust.Rule("block", "x.org", "/a"), url_trust.Rule("block", "", "")]
    pages = [(0, "http://a.h699.org/p699/x", None), (1, "http://h1.org/p1", ""), (2, "http://h2.org/p1", "x"), (3, "http://x.org/aaa", ""), (4, "http://yh699.org/p699", ""), (5, None, None), (6, "http://h698.org/p698", "")]
    for given in (rules, url_trust.rules_table(spark, rules)):
        got = {r.page_id: (r.rule, r.verdict) for r in url_trust.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), given).collect()}
        assert got == {0: ("h699.org/p699", "block"), 1: ("h1.org/p1", "block"), 2: (None, "allow"), 3: ("x.org/a", "block"), 4: (None, "allow"), 5: ("", "block"), 6: ("h698.org/p698", "allow")}
    assert url_trust.judge_pages(spark.createDataFrame([], "page_id long, url string, html string"), []).count() == 0


# Decontamination -----------------------------------------------------------------------


def test_passes_are_written(spark):
    items = [(i, say(random.Random(i), EN, 30)) for i in range(12)]
    docs = spark.createDataFrame([(i, "before it " + t + " after", "x") for i, t in items] + [(99, "nothing here", "y")], "doc_id long, text string, ranges string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, pass_bytes=200)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: str(r.doc_id) in r.item_ids for r in found.collect()} == {**{i: True for i in range(12)}, 99: False}


# Pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    fine = [say(rng, EN, 40) + f" number {i} of them all." for i in range(30)]
    shared = "This long line of text is in many of the documents"
    rows = [(i, t) for i, t in enumerate(fine)]
    rows += [(100, fine[3]), (102, "12 34 ..."), (103, None), (104, "we say " + say(random.Random(1), DE, 20) + " and more"), (105, "vile slurs shout " * 12)]
    rows += [(110 + i, f"{shared}\n{say(rng, EN, 30)} own {i}") for i in range(3)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", say(random.Random(1), DE, 20))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(105, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [*range(30), 110, 111, 112]
    text = {r.doc_id: r.text for r in out} if "text" in out[0] else {}
    assert not text or [shared in text[i] for i in (110, 111, 112)] == [False, False, True]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "domain_mixing"]
