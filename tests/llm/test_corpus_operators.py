"""The operators over small tables with every odd case, against brute force or SQL."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import same
from tributary.llm import bpe, common, decontaminate, jaccard, language_id, line_dedup, pii, queries, substring_dedup, toxicity, warc, webp

SF = "/root/testdata/sf0.001"
PASSAGE = "This passage of some length is found in several documents of the table and so it has to be caught wherever it stands, be it at the begin or at the end, or in the middle of other text that differs from case to case."


@pytest.fixture(scope="module")
def documents(spark):
    """Nulls in each column, empty, blank and long texts, exact and near copies, repeated rows, columns with names of our own."""
    words = [f"word{i * 7919 % 1013}" for i in range(600)]
    near = " ".join(words[:200])
    texts = {
        1: near, 2: near, 3: near.replace("word0", "other"), 4: None, 5: "", 6: "   \n \n", 7: PASSAGE + " First.", 8: "Second. " + PASSAGE, 9: "a", 10: "two words", 11: "two words",
        12: "line one of some length, which repeats in other documents\nshort\nx\n\nunique twelve", 13: "line one of some length, which repeats in other documents\nunique thirteen\nshort\nx", 14: "x\nx\nx",
        15: " ".join(words) * 60, 16: "ab" * 700, 17: "Ünïcödé — 日本語 🎉\tand 'quotes' it's", 18: "call +1 (243) 555-5526 or a.b@x.org",
    }
    rows = [(i, t, "en" if i % 3 else None, "s", None, i, "k") for i, t in texts.items()]
    rows += [rows[0], (None, "no id, but text that is long enough to count", None, None, 3, 1, "k"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, c long, k string").repartition(3)


@pytest.fixture(scope="module")
def empty(documents):
    return documents.where("false")


def plain_rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def raw(t):
    return (t or "").encode()


def test_language_id(spark, documents, empty):
    got = language_id.identify(documents).collect()
    assert len(got) == documents.count() and {r.lang_pred for r in got} <= {"en", "und"}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_language_id_learns_every_language(spark):
    """70 languages, each of letters of its own; the last has longer texts only."""
    word = lambda k, i: "".join(chr(0x4E00 + 40 * k + (i * j) % 37) for j in (3, 5, 7))
    rows = [(100 * k + i, " ".join(word(k, i + j) for j in range(6000 if k == 69 else 5)), f"l{k:02d}") for k in range(70) for i in range(6 if k > 60 else 8)]
    assert all(len(t) > 20_000 for _, t, lang in rows if lang == "l69")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_language_id_held_out(spark):
    df = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = [r for r in df.join(truth, "doc_id").where("held_out").collect() if r.lang]
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (2, None, "x"), (5, "u", "WARC/1.1\r\n\r\nü")], "page_id long, url string, html string")
    path = warc.write(pages, f"file://{tmp_path}/w")
    got = {(r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read(spark, path, verify="true").collect()}
    assert got == {(1, "revisit", 2, None), (2, "response", None, "x"), (3, "revisit", 4, None), (4, "response", None, ""), (None, "response", None, "x"), (5, "response", None, "WARC/1.1\r\n\r\nü")}
    some = warc.read(spark, path).where("record_type = 'revisit' and page_id in (1, 2)")
    assert [r.page_id for r in some.collect()] == [1]
    assert warc.read(spark, path, payload="none").where("payload is not null").count() == 0
    assert warc.read(spark, warc.write(pages.where("false"), f"file://{tmp_path}/e")).count() == 0
    large = warc.write(pages, f"file://{tmp_path}/l", min_payload_bytes=1)
    assert {r.page_id for r in warc.read(spark, large).where("record_type = 'revisit'").collect()} == {1}


def test_webp(documents, empty):
    for r in webp.read_media(webp.to_media(documents)).join(documents.select("doc_id", "text").distinct(), "doc_id").collect():
        payload = webp.padded(raw(r.text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw(r.text)), len(payload), hashlib.sha256(payload).hexdigest())
    assert webp.read_media(webp.to_media(empty)).count() == 0


def brute_classes(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    n, group = len(sets), list(range(len(sets)))
    links = [0] * n
    for a in range(n):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                group = [group[b] if g == group[a] else g for g in group]
    first = collections.defaultdict(list)
    for (i, _), g in zip(sets, group, strict=True):
        if i is not None:
            first[g].append(i)
    return sorted(((i, min(first[g], default=None), k) for (i, _), g, k in zip(sets, group, links, strict=True)), key=str)


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard(spark, documents, block):
    extra = spark.createDataFrame([(100 + i, " ".join(f"w{j}" if j != 3 * i else "changed" for j in range(90))) for i in range(12)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(extra)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs, block=block).collect()), key=str)
    assert got == brute_classes(plain_rows(docs))


def test_jaccard_stage(documents, empty):
    kept = jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*(set(range(1, 19)) - {2, 3, 8, 11}), None, None], key=str)
    assert jaccard.classes(empty).count() == 0


def test_bpe(documents, empty):
    import public_tokenizers as public
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.encoder(bpe.vocabulary_path()).ranks, special_tokens={})
    for r in bpe.encode_documents(documents, keep=True).collect():
        assert r.ids == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == raw(r.text) and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.decoded_sha256 for r in bpe.digests(documents).collect()}[17] == hashlib.sha256(raw(dict(plain_rows(documents))[17])).hexdigest()
    assert bpe.digests(empty).count() == 0


def test_decontamination(spark, documents, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, "nothing of this kind is anywhere in these documents at all, is it"), (3, None), (None, PASSAGE), (4, "two words"), (5, PASSAGE.upper())], "item_id long, text string")
    for size in (1 << 24, 1 << 16):
        found = decontaminate.contaminated(documents, items, sieve_bytes=size)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(7, 1), (7, 5), (8, 1), (8, 5), (10, 4), (11, 4)]
        kept = decontaminate.clean(documents, items, sieve_bytes=size)
        assert kept.columns == documents.columns and kept.count() == documents.count() - 4
    assert decontaminate.contaminated(empty, items).count() == 0 == decontaminate.contaminated(documents, items.where("false")).count()
    named = documents.withColumns({"d": F.lit(1), "item_id": F.lit(2), "_k": F.lit(3)})
    assert sorted(map(str, decontaminate.clean(named, items).drop("d", "item_id", "_k").collect())) == sorted(map(str, decontaminate.clean(documents, items).collect()))


def brute_overlaps(docs, items, min_words=13):
    """Every alignment and every run on it, by hand."""
    out = set()
    for d, text in docs:
        doc = re.findall(r"\w+", (text or "").lower())
        for i, t in items:
            item = re.findall(r"\w+", (t or "").lower())
            need = min(min_words, len(item))
            for z in range(-len(item), len(doc)) if item else ():
                same = [doc[z + j] == item[j] for j in range(len(item)) if 0 <= z + j < len(doc)]
                total = [0]
                for x in same:
                    total.append(total[-1] + x)
                if any(5 * (total[b] - total[a]) >= 4 * (b - a) for a in range(len(same)) for b in range(a + need, len(same) + 1)):
                    out.add((d, i))
                    break
    return out


def test_decontamination_by_brute_force(spark):
    """Items with substituted words at the very limit, parts of items in documents beside each other, hot words, short items."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((4, 6, 9, 12, 13, 14, 16, 20, 30, 60))))) for i in range(30)] + [(98, "very " * 40), (99, "very " * 16 + "hot")]
    docs = []
    for n in range(260):
        words = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            size = rng.choice((len(part), 13, 15, 16, 20))
            a = rng.randint(0, max(0, len(part) - size))
            part = part[a : a + size]
            for k in rng.sample(range(len(part)), min(len(part), len(part) // 5 + rng.choice((-1, 0, 0, 1)) if len(part) > 5 else 0)):
                part[k] = "zzz"
            words += part + [word() for _ in range(rng.randint(0, 4))]
        docs.append((n, " ".join(words)))
    docs += [(500, "very " * 5000), (501, items[-5][1][: len(items[-5][1]) // 2]), (502, items[-5][1][len(items[-5][1]) // 2 :])]
    want = brute_overlaps([d for d in docs if d[0] != 500], items) | {(500, 98), (500, 99)}
    assert len(want) > 60
    table, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 5):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table.repartition(parts), tests).collect()} == want


def test_pii(documents, empty):
    got = {r.doc_id: r for r in pii.pseudonymize(documents, "key").collect()}
    assert [e.kind for e in got[18].entities] == ["phone", "email"] and got[18].n_found == 2
    assert pii.restore(got[18].text, b"key") == dict(plain_rows(documents))[18] and got[4].text is None and got[5].text == ""
    assert pii.pseudonymize(empty, "key").count() == 0


def brute_lines(rows, min_chars=40, min_lines=2):
    """For each place the longest run that an earlier place begins too, by comparing all pairs."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {r: [(i, x.strip(" ")) for i, x in enumerate(r[1].split("\n")) if x.strip(" ")] for r in order}
    places = [(r, p) for r in order for p in range(len(lines[r]))]
    gone, longest = collections.defaultdict(set), collections.Counter()
    for n, (r, p) in enumerate(places):
        most = 0
        for q, o in places[:n]:
            k = 0
            while p + k < len(lines[r]) and o + k < len(lines[q]) and lines[r][p + k][1] == lines[q][o + k][1]:
                k += 1
            most = max(most, k)
        longest[r] = max(longest[r], most)
        cut = most if most >= min_lines else int(most > 0 and len(lines[r][p][1]) >= min_chars)
        gone[r] |= {lines[r][p + i][0] for i in range(cut)}
    text = lambda i, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
    return sorted(((i, text(i, t), len(gone[i, t]), longest[i, t]) for i, t in rows), key=str)


def line_rows(df):
    return sorted(((r.doc_id, r.text, r.n_removed, r.longest_run) for r in df.collect()), key=str)


def test_line_dedup(documents, empty):
    done = line_dedup.deduplicate(documents)
    assert done.columns == [*documents.columns, "n_lines", "n_removed", "longest_run"]
    assert line_rows(done) == brute_lines(plain_rows(documents))
    assert line_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("min_lines", [2, 4])
def test_line_dedup_runs(spark, min_lines):
    """Runs of all lengths that overlap, are cut out of longer ones and repeat within a document."""
    rng = random.Random(5)
    blocks = [[f"line {rng.randint(0, 30)}" + (" of a good forty characters at the very least" if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 25))] for _ in range(8)]
    rows = []
    for n in range(40):
        text = []
        for _ in range(rng.randint(0, 3)):
            block = rng.choice(blocks)
            a = rng.randint(0, len(block) - 1)
            text += block[a : a + rng.randint(1, 25)] + [""] * rng.randint(0, 1) + [f"own {rng.randint(0, 10**9)}"] * rng.randint(0, 1)
        rows.append((n, "\n".join(text)))
    rows += [(50, "\n".join(["x"] * 30)), (51, "\n".join(["a", "b"] * 20)), (52, "\n".join(["a", "b"] * 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert line_rows(line_dedup.deduplicate(docs, min_lines=min_lines)) == brute_lines(rows, min_lines=min_lines)


def test_line_dedup_maximal_runs(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "z\na\nb\nc"), (3, "b\nc\nq\na\nb"), (4, "a\nb\nc\nd\ne")], "doc_id long, text string")
    got = sorted((r.d, r.p, r.lines, r.copies) for r in line_dedup.maximal_runs(docs).collect())
    assert got == [(2, 1, 3, 3), (3, 0, 2, 4), (3, 3, 2, 4), (4, 0, 4, 2)]


def test_line_dedup_exact_runs_and_copies(spark):
    """Runs beside each other, whose bounds don't settle them at once: each length, and the copies of those that no longer one holds."""
    rng = random.Random(8)
    a, b = ([f"{x}{i}" for i in range(23)] for x in "ab")
    texts = [a, b, a[:13] + b[4:21], b[:9] + a[2:8] + a[1:20], [*a[5:9]] * 4, a, [rng.choice("xy") for _ in range(40)], [rng.choice("xy") for _ in range(40)]]
    docs = spark.createDataFrame([(n, "\n".join(t)) for n, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    places = [(n, p) for n, t in enumerate(texts) for p in range(len(t))]
    most = {}
    for i, (n, p) in enumerate(places):
        most[n, p] = max((next((k for k, (x, y) in enumerate(zip(texts[n][p:], texts[m][o:])) if x != y), min(len(texts[n]) - p, len(texts[m]) - o)) for m, o in places[:i]), default=0)
    runs, _ = line_dedup.later_runs(docs)
    got = {(r.d, r.p): (r.lines, r.copies) for r in runs.collect()}
    assert {x: k for x, (k, _) in got.items()} == {x: k for x, k in most.items() if k}
    heads = {(n, p): k for (n, p), k in most.items() if k and most.get((n, p - 1), 0) != k + 1}
    assert {x: got[x] for x in heads} == {(n, p): (k, sum(texts[m][o : o + k] == texts[n][p : p + k] for m, o in places)) for (n, p), k in heads.items()}


def test_line_dedup_work(spark, monkeypatch):
    """A text is split once for its result, and copies of whole documents are settled by one round of keys, whatever their length."""
    keys, stage = [], line_dedup.stage

    def counted(df, name):
        out = stage(df, name)
        keys.extend([out[0].count()] * (name == "line-keys"))
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    docs = spark.createDataFrame([(n, "\n".join(f"line {i}" for i in range(45))) for n in range(3)], "doc_id long, text string")
    done = line_dedup.deduplicate(docs)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r.n_lines, r.n_removed, r.longest_run) for r in done.orderBy("doc_id").collect()] == [(45, 0, 0), (45, 45, 45), (45, 45, 45)]
    assert keys == [3]


def test_line_dedup_columns(spark, documents):
    """Columns with names that the operator uses itself come back as they were."""
    odd = documents.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in ("d", "_d", "gone", "longest", "p", "n_removed", "size", "D_")})
    kept = line_dedup.deduplicate(odd, names=("a1", "a2", "a3"))
    assert kept.columns == [*odd.columns, "a1", "a2", "a3"]
    assert sorted(map(str, kept.drop("text", "a1", "a2", "a3").collect())) == sorted(map(str, odd.drop("text").collect()))
    assert [c for c in line_dedup.deduplicate(odd).columns if c == "n_removed"] == ["n_removed"]


def test_line_dedup_is_native(documents):
    plan = line_dedup.deduplicate(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_repeats(rows, length=200):
    data = [(i, raw(t)) for i, t in rows]
    count = collections.Counter(b[j : j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        hit = [False] * len(b)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                hit[j : j + length] = [True] * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), sum(hit), sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [256, 2])
def test_substring_dedup(spark, documents, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    extra = spark.createDataFrame([(50 + i, f"{'pad ' * (i * 3)}{PASSAGE}{i}{'y' * i}") for i in range(9)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").where("doc_id <> 15 or doc_id is null").unionByName(extra)
    assert sorted((tuple(r) for r in substring_dedup.digests(docs).collect()), key=str) == brute_repeats(plain_rows(docs))


def test_substring_dedup_outputs(documents, empty):
    rows = {r.doc_id: r for r in substring_dedup.remove(documents.where("doc_id in (7, 8, 9)")).collect()}
    assert bytes(rows[7].kept) == b" First." and bytes(rows[8].kept) == b"Second. " and rows[9].spans == []
    assert substring_dedup.digests(empty).count() == 0


def test_toxicity(spark, documents, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for own in (labels, labels.where("toxic = 0"), labels.where("false")):
        got = toxicity.score(documents, own).collect()
        assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score(documents, labels, keep=True).columns == [*documents.columns, "score", "predicted"]
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_held_out(spark):
    """Ranking and decisions on the held-out fold, the mean of three models that differ in the order of the sample and in their first values."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels, "doc_id").withColumn("fold", common.crc_mod("doc_id", 4)).orderBy("doc_id").collect()
    learn, held = [r for r in rows if r.fold != 2 and r.text], [r for r in rows if r.fold == 2]
    aucs, recalls, precisions = [], [], []
    for seed in range(3):
        order = random.Random(seed).sample(range(len(learn)), len(learn))
        scores = toxicity.fit([learn[i].text[:8000] for i in order], [learn[i].toxic for i in order], seed=seed).score([r.text for r in held])
        bad = [s for s, r in zip(scores, held, strict=True) if r.toxic == 1]
        good = [s for s, r in zip(scores, held, strict=True) if r.toxic == 0]
        aucs.append(sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)))
        caught, wrong = sum(s >= 0.3 for s in bad), sum(s >= 0.3 for s in good)
        recalls.append(caught / len(bad)), precisions.append(caught / (caught + wrong))
    mean = lambda v: sum(v) / len(v)
    assert mean(aucs) > 0.955 and mean(recalls) > 0.64 and mean(precisions) > 0.84


def test_columns_with_names_of_the_operators(spark, documents):
    """Columns that clash with an operator's own give way where it says so, and are kept by the pipeline's stages."""
    odd = documents.withColumns({n: F.lit(n) for n in ("score", "predicted", "n_tokens", "n_removed", "n_lines", "d", "k2", "__k", "__d")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 19)], "doc_id long, toxic int")
    scored = toxicity.score(odd, labels, keep=True)
    assert sorted(scored.columns) == sorted(odd.columns) and all(0 <= r.score <= 1 for r in scored.collect())
    assert sorted(bpe.digests(odd, keep=True).columns) == sorted([*odd.columns, "ids_sha256", "decoded_sha256"])
    assert {r.n_tokens for r in bpe.digests(odd, keep=True).where("doc_id in (4, 5)").collect()} == {0}
    for each in (jaccard.one_of_each, lambda df: decontaminate.clean(df, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))):
        kept = each(odd)
        assert kept.columns == odd.columns and {r.predicted for r in kept.collect()} == {"predicted"}
