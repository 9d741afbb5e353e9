"""The operators on small tables, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import chat_trees, decontaminate, domain_mixing, language_id, line_dedup, line_quality, ngram_join, pseudonyms, secret_scan, url_trust

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def make_texts():
    rng = random.Random(3)
    vocab = ["the", "and", "Ünder", "was", "ß", "Ion", "x1", "of"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "Two words", "a b c d", base[0], base[0], base[1] + "\n" + base[2]]
    for _ in range(25):  # near copies of one text
        w = base[3].split()
        w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    line = "This very line is shared by many"
    out += [f"{line}\nown {i}\n  {line.upper()} \nAnother shared line of text {i % 2}" for i in range(5)]
    out.append(" ".join(rng.choice(vocab) for _ in range(4000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, none):
    df, texts = docs
    sets = {}
    for i, t in texts.items():
        w = SPACE.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect()}
    assert got == {i: (len(sets[i]), min(group[i])) for i in sets}
    assert ngram_join.similar_components(none).count() == 0
    assert ngram_join.keep_one_of_each(df).columns == df.columns


@pytest.mark.parametrize("settings", [{"OUTSIDE": 10**6}, {"LEAST_CELL": 2, "OUTSIDE": 0, "BLOCK_MEMBERS": 3}])
def test_ngram_join_finds_all_links_by_each_way(spark, monkeypatch, settings):
    """Chains of near copies that no single pivot reaches, and lists in several cells."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(3):
        w = [rng.choice(vocab) for _ in range(80)]
        for _ in range(25):
            w = list(w)
            w[rng.randrange(80)] = rng.choice(vocab)
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(77)} for t in texts]
    group = list(range(len(texts)))
    links = [(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for i, j in links:
        group = [group[i] if g == group[j] else g for g in group]
    want = {i: min(k for k, g in enumerate(group) if g == group[i]) for i in range(len(texts))}
    for k, v in settings.items():
        monkeypatch.setattr(ngram_join, k, v)
    join = ngram_join.Join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).run()
    assert {r.doc_id: r.component_id for r in join.documents().collect()} == want
    # No pair was verified with fewer matches than min(L1, L2), nor twice.
    blob = {r.row: np.frombuffer(r.blob, dtype=np.uint64) for r in join.sets.where("blob is not null").select("row", "blob").collect()}
    pairs = [(r.a, r.b) for t in join.tested for r in t.collect()]
    assert len(pairs) == len(set(pairs))
    for a, b in pairs:
        p, q = (join.prefixes.prefix(blob[x]) for x in (a, b))
        least = min(p[3], q[3])
        assert len(np.intersect1d(p[0][p[2] <= least], q[0][q[2] <= least])) >= least


def test_ngram_blocks_give_joining_links_only():
    """However many members are alike, a block gives fewer links than it has members; none within a component."""
    s = np.arange(40, dtype=np.uint64).tobytes()
    member = pa.struct([("node", pa.int64()), ("label", pa.int64()), ("blob", pa.binary())])

    def links(labels):
        block = pa.array([[{"node": i, "label": x, "blob": s} for i, x in enumerate(labels)]], pa.list_(member))
        batch = pa.RecordBatch.from_arrays([block, block], names=["sets_a", "sets_b"])
        none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        (out,) = ngram_join._Blocks(ngram_join.Prefixes(85, *none))([batch])
        return list(zip(*(c.to_pylist() for c in out.columns), strict=True))

    found = links(range(50))
    group = list(range(50))
    for a, b in found:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(found) == 49 and len(set(group)) == 1
    assert links([7] * 50) == [] and len(links([7] * 25 + [8] * 25)) == 1


def test_ngram_postings_in_slices():
    """The slices have all postings between them, each once and all of a shingle in one; no slice has most of them."""
    batch = pa.RecordBatch.from_arrays([pa.array([b" ".join(b"w%d" % (i * j) for j in range(200)) for i in range(1, 9)], pa.binary())], names=["text"])
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    rows = lambda *k: [r for out in ngram_join._Postings(ngram_join.Prefixes(85, *none), 256, 4, *k)([batch]) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    every, parts = rows(), [rows(k, 3) for k in range(3)]
    assert sorted(every) == sorted(sum(parts, [])) and max(map(len, parts)) < len(every) / 2
    assert not {r[0] for r in parts[0]} & {r[0] for r in parts[1]}


def test_keep_one_of_each_row(spark):
    t, u = "one two three four five six seven", "other words that are not like those"
    rows = [(5, t, 1), (5, t, 2), (7, t, 3), (None, t, 4), (5, u, 5), (None, u, 6), (None, "", 7), (None, None, 8), (9, "", 9), (9, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long").selectExpr("*", "id as last", "id as text_hash", "id as row", "id as __keep")
    out = ngram_join.keep_one_of_each(df)
    got = sorted((r.doc_id or 0, r.text or "", r.id) for r in out.collect())
    assert out.columns == df.columns and [x[2] for x in got if not x[1]] == [7, 8, 9, 10]
    assert [x[:2] for x in got if x[1]] == [(5, t), (5, u)] or [x[:2] for x in got if x[1]] == [(5, u), (5, t)]


def test_line_dedup(docs, none):
    df, texts = docs
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    for batches, fan_in in ((1, 2), (4, 3), (9, 2)):
        for r in line_dedup.dedup_lines(df, batches=batches, fan_in=fan_in).collect():
            lines = (texts[r.doc_id] or "").split("\n")
            kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id]
            assert (r.n_lines, r.n_dropped, r.text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_goes_through_runs(docs, monkeypatch):
    """The registered parameters take several batches, anti-joins and a compaction on any table."""
    df, _ = docs
    stores, plans = [], []
    add, write = line_dedup.LineRuns.add, line_dedup.LineRuns._write
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, batch: (stores.append(self), add(self, batch))[1])
    monkeypatch.setattr(line_dedup.LineRuns, "_write", lambda self, rows, level: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, level))[1])
    line_dedup.dedup_lines(df)
    assert len({id(s) for s in stores}) == 1 and stores[0].batches == line_dedup.BATCHES and stores[0].compactions == 1
    assert [len(x) for x in stores[0].levels] == [1, 1]
    assert [p.count("SortMergeJoin") for p in plans] == [0, 1, 2, 0, 1]
    assert all(p.count("Exchange hashpartitioning") == 1 for p in plans), "only the batch is shuffled, never a run that it is joined with"


def test_line_store_first_batch_keeps(spark):
    """The anti-join decides: a later batch with a larger id gets no keeper. The store opens again."""
    root = line_dedup.Scratch(spark, "store").path("runs")
    store = line_dedup.LineRuns(spark, root, buckets=3, fan_in=2)
    rows = lambda *x: spark.createDataFrame([(bytes(h, "ascii"), n, top) for h, n, top in x], "h binary, n long, top long")
    store.add(rows(("a", 1, 5), ("b", 2, 6)))
    store.add(rows(("a", 1, 9), ("c", 1, 9)))
    store = line_dedup.LineRuns.open(spark, root)
    store.add(rows(("a", 1, 11), ("b", 1, 12), ("c", 4, 13)))
    want = {b"a": (3, 5), b"b": (3, 6), b"c": (5, 9)}
    assert {bytes(r.h): (r.n, r.keeper) for r in store.holders().collect()} == want
    store.compact()
    store = line_dedup.LineRuns.open(spark, root)
    assert len(store.all()) == 1 and {bytes(r.h): (r.n, r.keeper) for r in store.holders().collect()} == want
    line = "A line that is long enough to count"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in (1, 2)], "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(docs, store=store).collect()) == 0
    more = spark.createDataFrame([(7, line)], "doc_id long, text string")
    assert line_dedup.dedup_lines(more, store=store).first().n_dropped == 1


def test_line_dedup_defined_cases(spark):
    line = "A line that is long enough to count"
    rows = [(1, line, "x"), (1, line, "x"), (None, line, "y"), (4, line + "\n" + "z" * 200_000, None), (5, None, "w"), (6, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, drop string").selectExpr("*", "drop as row", "1 as n_lines", "drop as lost_id", "drop as text_hash", "drop as h")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "drop", "row", "lost_id", "text_hash", "h", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.drop, r.n_lines, r.n_dropped, len(r.text)) for r in out.collect()) == [("1", "x", 1, 1, 0)] * 2 + [("4", None, 2, 0, 200_036), ("5", "w", 1, 0, 0), ("6", "v", 1, 0, 0), ("None", "y", 1, 1, 0)]


def test_decontamination(spark, docs, none):
    df, texts = docs
    items = [(1, texts[6]), (10, "own 3 another"), (2, None), (3, "Two"), (None, "no such thing at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add("" if i is None else str(i))
    for size in (1 << 20, 64):
        for r in decontaminate.find_contamination(df, bench, pass_bytes=size).collect():
            w = ALNUM.findall((texts[r.doc_id] or "").translate(LOW))
            hit, found = set(), set()
            for m in {len(k) for k in windows}:
                for j in range(len(w) - m + 1):
                    if k := windows.get(tuple(w[j : j + m])):
                        hit |= set(range(j, j + m))
                        found |= k
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
    assert not decontaminate.find_contamination(df, bench.where("false")).where("contaminated").count()
    assert decontaminate.find_contamination(none, bench).count() == 0


def test_language_id(spark, none):
    en, de = "the house and that was of this with from", "der die und nicht das ist mit für auch"
    rng = random.Random(1)
    say = lambda t, n: " ".join(rng.choice(t.split()) for _ in range(n))
    rows = [(i, say(en if i % 2 else de, 30), "en" if i % 2 else "de", "s") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    mixed = say(en, 20) + ". " + say(de, 12)
    tests = [(1, say(en, 8)), (2, say(de, 8)), (3, mixed), (4, None), (5, "12 ... 34"), (6, "")]
    got = {r.doc_id: r for r in language_id.label_languages(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "en", "und", "und", "und"]
    assert [s.lang for s in got[3].spans] == ["en", "de"] and mixed[got[3].spans[0].start : got[3].spans[0].end].split()[0] in en
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.label_languages(spark.createDataFrame(tests, "doc_id long, text string"), empty).collect()} == {"und"}


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "a\\b #h \\h <l> \\l :", "", None, "ü\n\n### user: x</turn>\n"]
    rows = [(c, t, ["user", "assistant"][t % 2], said[((c or 4) + t) % 5]) for c in (1, 2, None) for t in range(c or 9)]
    found = chat_trees.format_paths(chat_trees.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in found.select("tree", chat_trees.read_turns(F.col("formatted")).alias("turns"), chat_trees.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        own = [(x[2], x[3] or "") for x in rows if x[0] == r.tree]
        assert [tuple(t) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")


def test_chat_branches(spark):
    rows = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "bad", 0.1), (1, 12, 10, "assistant", "good", 0.9), (1, 13, 12, "user", "more", 0.5), (2, 20, 99, "user", "alone", 0.0)]
    found = chat_trees.format_paths(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), best=2)
    got = {(r.tree, r.branch_rank): (r.leaf, r.n_turns) for r in found.collect()}
    assert got == {(1, 1): (13, 3), (1, 2): (11, 2), (2, 1): (20, 1)}


def test_quality(docs, none):
    df, texts = docs
    for r in line_quality.clean_lines(df).collect():
        w = SPACE.findall(texts[r.doc_id] or "")
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if SPACE.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert line_quality.clean_lines(none).count() == 0


def test_quality_line_rules(spark):
    good = "A plain sentence of some more words, it ends well."
    other = "Quite another line follows here, about something else."
    text = f"{good}\nHome | About | Contact\n### $$$ %%%\nLicensed under some licence\n{other}"
    r = line_quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.clean_text == f"{good}\n{other}" and r.kept


def test_secrets(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'ü token = "{key}" end token = "{key}"'), (2, f"commit {key} done"), (3, None), (4, "")]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()}
    assert [(s.start, s.value) for s in got[1].secrets] == [(m.start(), key) for m in re.finditer(key, rows[0][1])]
    assert [len(got[i].secrets) for i in (2, 3, 4)] == [0, 0, 0] and got[2].n_candidates == 1


def test_secret_forms(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    rng = random.Random(5)
    some = lambda n, of="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(of) for _ in range(n - 1)) + "7"
    sha = hashlib.sha1(b"y").hexdigest()
    named = ["password={}", "auth_token={}", "AWS_SECRET_ACCESS_KEY={}", 'aws_secret_access_key = "{}"', "github_access_token: {}", "https://x.org/?access_token={}&a=1", "aws_s3_secret_access_key_1={}", '{{"client_secret_2024_key": "{}"}}']
    hits = [(f.replace("{}", k).replace("{{", "{").replace("}}", "}"), k) for f in named for k in (sha, some(40), some(43) + "=")]
    hits += [(f"we use {k} for it", k) for k in ("AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ghp_" + some(36), some(40))]
    hits += [(f'commit {sha} token = "{k}"', k) for k in [some(32)]]
    misses = [f"commit {sha}", f"the {sha} is known", "class TestModuleConfigDocument2024", 'token = "x", sha256: ' + hashlib.sha256(b"z").hexdigest(), "report_file_version_2024_1=3", "see https://example.com/docs/page_1234567890ab"]
    rows = [(i, t) for i, t in enumerate([t for t, _ in hits] + misses)]
    got = {r.doc_id: [(s.start, s.value) for s in r.secrets] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()}
    assert [(rows[i][1], got[i]) for i in got] == [(t, [(t.index(k), k)]) for t, k in hits] + [(t, []) for t in misses]


def test_pseudonyms(spark):
    text = "call +1 (017) 555-7713 card 4111111111111111 on 2024-02-29 or 31.12.1999 from 10.0.0.1, not 999.1.1.1 or 2024-02-30 or 4111111111111112, mail a.b@x.org"
    out = [r for r in pseudonyms.pseudonymise(spark.createDataFrame([(1, text), (2, "x " + text), (3, None), (4, "")], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [v.kind for v in out[0]["values"]] == ["phone", "card", "date", "date", "ip", "mail"]
    assert out[1].text == "x " + out[0].text and out[2].text is None and out[3].text == ""
    for v in out[0]["values"]:
        old = text[v.start : v.start + v.length]
        assert old != v.pseudonym and (v.kind in ("ip", "mail") or len(old) == len(v.pseudonym))
    assert "999.1.1.1 or 2024-02-30 or 4111111111111112" in out[0].text


def test_pseudonym_forms(spark):
    phones = ["(555) 123-4567", "555-123-4567", "555.123.4567", "1-800-555-0199", "+1 (476) 555-6291", "+44 20 7946 0958", "+14155552671", "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "0044 20 7946 0958", "020 7946 0958"]
    dates = ["2024-02-29", "31/12/1999", "12/31/1999", "1/2/2024", "2024-1-5", "1.2.2024", "31.12.1999", "31-12-1999", "2024/03/04"]
    cards = ["4111 1111 1111 1111", "3782 822463 10005", "3782-822463-10005", "378282246310005"]
    keep = ["2024-02-30", "31/13/1999", "3782 822463 10006", "10.20.2024.5", "12345678", "978-0-306-40615-7", "3.14159", "1,234,567"]
    forms = [(k, x) for k, xs in (("phone", phones), ("date", dates), ("card", cards), (None, keep)) for x in xs]
    rows = [(i, f"on {x}, 2 of") for i, (_, x) in enumerate(forms)]
    rows.append((len(forms), "+49 30 123456 31.12.1999 and +49 30 123456 2024-02-29"))
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    found = {x: [(v.kind, rows[i][1][v.start : v.start + v.length]) for v in out[i]["values"]] for i, (_, x) in enumerate(forms)}
    assert found == {x: [(k, x)] if k else [] for k, x in forms}
    for i, (k, x) in enumerate(forms):
        new = out[i].text[3 : len(out[i].text) - 6]
        assert (new != x) == bool(k) and (k == "date" or re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", x))
        if k == "date":
            assert re.sub("[0-9]+", "0", new) == re.sub("[0-9]+", "0", x)
    assert int(out[len(phones) + 1].text[3:5]) > 12
    assert [v.kind for v in out[len(forms)]["values"]] == ["phone", "date", "phone", "date"]
    assert pseudonyms.pseudonymise(spark.createDataFrame([(1, "room 12 555-123-4567")], "doc_id long, text string"), "k").first()["values"][0].start == 8


def test_late_dates_are_permuted(spark):
    days = spark.range(3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("dayofmonth(d) > 12")
    rows = days.select(F.date_format("d", "dd/MM/yyyy").alias("text"), F.monotonically_increasing_id().alias("doc_id"))
    new = [r.text for r in pseudonyms.pseudonymise(rows, "k").collect()]
    assert len(set(new)) == len(new) and all(int(x[:2]) > 12 for x in new)


def test_feistel_inverse(spark):
    rows = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("d"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    new = rows.select("d", "day", pseudonyms.permute_digits(F.col("d"), "k").alias("e"), pseudonyms.permute_date(F.col("day"), "k").alias("f"))
    back = new.select("*", pseudonyms.permute_digits(F.col("e"), "k", inverse=True).alias("d2"), pseudonyms.permute_date(F.col("f"), "k", inverse=True).alias("day2")).collect()
    assert all(r.d == r.d2 and r.day == r.day2 for r in back) and len({r.e for r in back}) == len({r.f for r in back}) == 2000


def test_mixing(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 4 else "bad stuff there ") * 5, "en", "s") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    rows = domain_mixing.mix(docs, labels, {"1_0": 0.5, "0_0": 0.5}).collect()
    p, t, rate = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    total = p.T @ (t * rate)
    assert abs(total[0] / total.sum() - 0.5) < 0.01 and (rate >= 0).all()
    assert domain_mixing.mix(docs.where("false"), labels).count() == 0


def test_mixing_reaches_rare_domains(spark):
    rng = np.random.default_rng(1)
    n, shares = 4000, [0.01, 0.002, 0.30, 0.688]
    of = rng.choice(4, n, p=shares)
    p = np.exp(2.5 * np.eye(4)[of] + rng.normal(size=(n, 4)))
    p /= p.sum(1, keepdims=True)
    tokens = rng.integers(1, 2000, n)
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "n_tokens long, posteriors array<double>")
    for weights in ([0.05, 0.05, 0.20, 0.70], [0.02, 0.01, 0.17, 0.80]):
        targets = np.array(weights) * tokens.sum()
        w, left = domain_mixing.solve_rates(table, targets)
        got = p.T @ (tokens * np.maximum(0, 1 - p @ w))
        assert np.allclose(got - targets, left, atol=1e-3)
        # No better rates: those above 0 gain nothing by a change, those at 0 nothing by growth.
        gain = p @ left
        assert (np.abs(gain[1 - p @ w > 1e-9]) < 1e-3 * tokens.sum()).all() and (gain > -1e-3 * tokens.sum()).all()
        if weights[0] == 0.05:
            assert np.abs(left).sum() <= 2e-4 * tokens.sum()
    with pytest.raises(RuntimeError):
        domain_mixing.solve_rates(table, np.array([0.05, 0.05, 0.20, 0.70]) * tokens.sum(), max_steps=1)


def test_pipeline_mixing_drops_toxic_documents_only(spark, tmp_path):
    kinds = [("good words here ", 1, 0)] * 8 + [("poor stuff there ", 0, 0)] * 9 + [("vile slurs shout ", 1, 1), ("crude hate yell ", 0, 1), ("crude hate yell ", 0, 1)]
    of = [kinds[i % 20] for i in range(400)]
    docs = spark.createDataFrame([(i, k[0] * 8, "en", "s") for i, k in enumerate(of)], SCHEMA)
    spark.createDataFrame([(i, k[1], k[2]) for i, k in enumerate(of) if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, k in enumerate(of) if not k[2]] and min(r.copies for r in rows) >= 1
    tokens = [sum(r.n_tokens * r.rate for r in rows if of[r.doc_id][1] == q) for q in (0, 1)]
    assert tokens[0] / sum(tokens) == pytest.approx(0.17 / 0.97, abs=0.02)


def test_url_trust(spark):
    link = lambda *h: "".join(f'<a class="x" href="http://{x}/p">t</a>' for x in h)
    rows = [(1, "http://good.org/a", link("friend.net")), (2, "https://BAD.com/x/1?q", ""), (3, "http://farm.net/", link("bad.com")), (4, "http://friend.net/z#f", "<a href=/in>"), (5, None, None), (6, "no host", link("good.org"))]
    rules = [url_trust.Rule("allow", "org", "/"), url_trust.Rule("block", "bad.com", "/x")]
    got = {r.page_id: r for r in url_trust.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    assert (got[2].host, got[2].path, got[2].rule, got[5].host) == ("bad.com", "/x/1", "bad.com/x", "")
    assert got[4].trust == pytest.approx(0.15 * 0.85)
    assert (got[4].host, got[6].host) == ("friend.net", "")


def test_url_distrust_reaches_the_end_of_a_chain(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">t</a>') for i in range(20)] + [(20, "http://h20.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_trust.judge_pages(pages, [url_trust.Rule("block", "h20.net", "/")]).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    assert got[0].distrust == pytest.approx(0.15 * 0.85**20)
    with pytest.raises(RuntimeError):
        url_trust.judge_pages(pages, [url_trust.Rule("block", "h20.net", "/")], rounds=5)
