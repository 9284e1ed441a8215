"""Scanned pages, leakage, mixing and truncation: brute force, fixtures, held-out accuracy."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioframe.llm import leakage as L, mixing as M, ocr_repair as O, truncation as T

# -- leakage ----------------------------------------------------------------------------------------------------------
DOC, ITEM = "doc_id long, text string, item string, at int", "item_id long, quote string, question string, gram string"


def brute_leaks(docs, items, n):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = split(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, *passages in items:
            for p in passages:
                x = split(p)
                if d is not None and i is not None and any(tuple(x[j : j + n]) in grams for j in range(len(x) - n + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("per_pass", [4_000_000, 10])
def test_leaks(spark, per_pass):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei über".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 9))), " ".join(word() for _ in range(6))) for i in range(12)] + [(50, None, None), (51, "", "short")]
    docs = [(d, " ".join(word() for _ in range(rng.randint(0, 30)))) for d in range(60)] + [(90, None), (91, ""), (None, items[0][1])]
    docs.append((92, "X **" + items[0][2].replace(" ", "**,\n> ").upper() + "**."))
    ddf = spark.createDataFrame([(*d, "x", 1) for d in docs], DOC)
    idf = spark.createDataFrame([(*i, "x") for i in items], ITEM)
    found = L.leaked_windows(ddf, idf, doc="doc_id", text="text", item="item_id", passages=["quote", "question"], n=4, grams_per_pass=per_pass)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_leaks(docs, items, 4)
    assert (92, 0) in brute_leaks(docs, items, 4)


def test_leak_edges_and_removal(spark):
    text = "Before it. One two three, FOUR five! After it, more words stay here."
    ddf = spark.createDataFrame([(1, text, "x", 0), (2, "nothing here", "y", 0), (3, None, "z", 0), (4, "one two three four five", "w", 0)], DOC)
    idf = spark.createDataFrame([(7, "one two three four five", None, "x")], ITEM)
    win = L.leaked_windows(ddf, idf, doc="doc_id", text="text", item="item_id", passages=["quote", "question"], n=4)
    assert {tuple(r) for r in L.leaks(win, "doc_id", "item_id", 4).collect()} == {(1, 7, 2, 2, 7), (4, 7, 2, 0, 5)}
    clean = {r["doc_id"]: r["text"] for r in L.remove_leaks(ddf, win, doc="doc_id", text="text", n=4).collect()}
    assert clean == {1: "Before it. After it, more words stay here.", 2: "nothing here", 3: None}
    long = "z0 " + " ".join(f"w{i % 50} one two three four five" for i in range(3)) + " end."
    win = L.leaked_windows(spark.createDataFrame([(5, long, "x", 0)], DOC), idf, doc="doc_id", text="text", item="item_id", passages=["quote"], n=4)
    ddf5 = spark.createDataFrame([(5, long, "x", 0)], DOC)
    assert [r["text"] for r in L.remove_leaks(ddf5, win, doc="doc_id", text="text", n=4, drop_above=0.9).collect()] == ["z0 w0 w1 w2 end."]
    none = L.leaked_windows(ddf.limit(0), idf, doc="doc_id", text="text", item="item_id", passages=["quote"], n=4)
    assert none.count() == 0
    assert L.leaked_windows(ddf, idf.limit(0), doc="doc_id", text="text", item="item_id", passages=["quote"], n=4).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------------------
def sizes(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, rng.randint(1, 400)) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 20 + [None] * 10 + ["untargeted"] * 30)]
    return rows, spark.createDataFrame(rows + [(9999, "mid", 0)], "id long, source string, tokens long")


def test_mix(spark):
    rows, df = sizes(spark)
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.1, 2), ("absent", 0.1, 5), (None, 0.2, 1)], "source string, weight double, max_repeats int")
    plan = {r["source"]: r for r in M.mixing_plan(df, targets).collect()}
    total = sum(t for _, s, t in rows if s)
    own = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "mid", "small")}
    assert {s for s, r in plan.items() if r["short"]} == {s for s, w, m in (("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.1, 2), ("absent", 0.1, 5)) if w * total > m * own.get(s, 0)}
    mixed = M.mix(df, M.mixing_plan(df, targets), shard_tokens=20_000, block_tokens=500)
    got = mixed.collect()
    by, copies, places = {}, {}, set()
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"]
        copies.setdefault((r["source"], r["id"]), []).append(r["copy"])
        places.add((r["shard"], r["position"]))
    limit = {"big": 2, "mid": 3, "small": 2}
    for s, planned in ((s, plan[s]["planned"]) for s in own):
        assert planned - 400 <= by[s] <= planned
    assert all(len(c) == len(set(c)) <= limit[s] for (s, _), c in copies.items())
    assert len(places) == len(got)
    shards = {r["shard"] for r in got}
    assert len(shards) == -(-int(sum(plan[s]["planned"] for s in own)) // 20_000)
    again = M.mix(df, M.mixing_plan(df, targets), shard_tokens=20_000, block_tokens=500).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    share = {r["source"]: r["share"] for r in M.shares(mixed, M.mixing_plan(df, targets)).collect()}
    assert share["absent"] == 0.0 and sum(share.values()) == pytest.approx(1.0)


def test_splitting_tree_adds_up():
    import pandas as pd

    names, counts = ["a", "b", "c"], [100_000, 3_700, 30]
    quota = pd.DataFrame({"source": names, "n": counts})
    shards = 2 * M.WALK + 13
    parts = pd.concat([M._quotas(shards, 5)((0, stretch), quota) for stretch in range(3)])
    assert parts.groupby("source")["blocks"].sum().to_dict() == dict(zip(names, counts))
    per = parts.groupby("shard")["blocks"].sum()
    assert len(per) == shards and per.max() - per.min() <= 1


def test_many_sources_and_blocks(spark):
    """More sources than a tree holds, more blocks than a run: still all quotas, no document too often."""
    rng = random.Random(6)
    rows = [(i, f"s{i % 30}", rng.randint(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([(f"s{n}", 1 / 30, 2) for n in range(30)], "source string, weight double, max_repeats int")
    plan = M.mixing_plan(df, targets)
    got = M.mix(df, plan, shard_tokens=30_000, block_tokens=300, run=7, tree=4).collect()
    by, seen = {}, set()
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"]
        assert (r["id"], r["copy"]) not in seen and r["copy"] < 2
        seen.add((r["id"], r["copy"]))
    for r in plan.collect():
        assert r["planned"] - 400 <= by[r["source"]] <= r["planned"]
    sizes_of = {}
    for r in got:
        sizes_of[r["shard"]] = sizes_of.get(r["shard"], 0) + r["tokens"]
    assert len(sizes_of) == -(-int(sum(r["planned"] for r in plan.collect())) // 30_000) and max(sizes_of.values()) < 45_000


def test_mix_edges(spark):
    _, df = sizes(spark)
    t = "source string, weight double, max_repeats int"
    for d, targets in ((df.limit(0), [("big", 1.0, 1)]), (df, []), (df, [("big", None, None)])):
        plan = M.mixing_plan(d, spark.createDataFrame(targets, t))
        assert M.mix(d, plan).count() == 0
        assert M.shares(M.mix(d, plan), plan).count() == len(targets)


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 20_000,), ("数据 и ß",)], "t string")
    got = [r["n"] for r in df.select(M.token_counts(F.col("t")).alias("n")).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 100 and got[4] > 3


# -- truncation -------------------------------------------------------------------------------------------------------
NOUNS, VERBS, ADJ = "table cell filter index vector ledger parser".split(), "reads writes checks merges".split(), "green small shared nested".split()


def sentence(rng):
    n, v, a = (lambda: rng.choice(NOUNS)), (lambda: rng.choice(VERBS)), (lambda: rng.choice(ADJ))
    return rng.choice([f"The {a()} {n()} {v()} the {n()} because the {n()} {v()} only {a()} {n()}s.", f"Each {n()} keeps {rng.randint(2, 90)} {n()}s and one {a()} {n()}.", f"After {rng.randint(2, 9)} {n()}s the {a()} {n()} {v()} the rest."])


def test_sentence_model_on_held_out_sentences():
    rng = random.Random(3)
    weights = T.train([" ".join(sentence(rng) for _ in range(6)) for _ in range(400)])
    whole = [sentence(rng).rstrip(".") for _ in range(300)]
    cut = [" ".join(s.split()[: rng.randint(1, len(s.split()) - 1)]) for s in whole]
    right = sum(T.whole_probability(weights, s) >= 0.5 for s in whole) + sum(T.whole_probability(weights, s) < 0.5 for s in cut)
    assert right / 600 >= 0.95


def test_truncated(spark):
    rng = random.Random(5)
    docs, cut = [], set()
    for i in range(600):
        text, source = " ".join(sentence(rng) for _ in range(rng.randint(3, 9))), rng.choice(["free", "chars", "bytes", None])
        if source == "chars" and len(text) > 300:
            text = text[:300] + "..."
            cut.add(i)
        if source == "bytes":
            text = text.replace("The", "Thé")
            if len(text.encode()) > 300:
                text = text.encode()[:300].decode(errors="ignore")
                cut.add(i)
        docs.append((i, text, source, "x"))
    base = " ".join(sentence(rng) for _ in range(3))
    whole = [base + e for e in ("\n\n- Green table\n- Small cell", "\n\n| a | b |\n|---|---|\n| 1 | 2 |", "\n\n-- the table team", "\n\nSee also: docs/a/b.md", " And so on...", "\n\n```\nload x\n```", "\n\n# Head\n\nAfter 3 tables the green cell reads the rest")]
    broken = [base + e for e in ("\n\n| a | b |\n|---|---|\n| 1 |", "\n\n```\nload", " The green table reads the", " Each table keeps 3 cells and one green parse", " The green tab�", " After 3 tables the [more]")]
    docs += [(1000 + i, t, "free", "x") for i, t in enumerate(whole)] + [(2000 + i, t, "free", "x") for i, t in enumerate(broken)] + [(3000, None, "free", "x"), (3001, "", None, "x"), (3002, "word " * 200_000 + "end.", "free", "x"), (3003, "The team reads the rest. " * 3 + base, "free", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, how string")
    got = {r["doc_id"]: r["how"] for r in T.truncated(df, doc="doc_id", text="text", source="source").collect()}
    assert {i for i in got if i < 1000} >= {i for i in cut if docs[i][2] == "chars"}
    assert len({i for i in got if i < 1000} ^ cut) <= 0.03 * len(cut) + 2
    assert {i for i in got if i >= 1000} == {2000 + i for i in range(len(broken))}
    limits = {r["source"]: (r["measure"], r["limit"]) for r in T.field_limits(df, source="source", text="text").collect()}
    assert limits == {"chars": ("characters", 300), "bytes": ("bytes", 300)}
    rates = {r["source"]: r for r in T.source_rates(df, T.truncated(df, doc="doc_id", text="text", source="source"), source="source", text="text").collect()}
    assert set(rates) == {"free", "chars", "bytes", None} and rates["chars"]["by_limit"] > 10
    assert T.truncated(df.limit(0), doc="doc_id", text="text", source="source").count() == 0


def test_signs_of_ones_own(spark):
    """Marks and phrases are tables: others can be passed, and those of no list are no signs."""
    own, weights = T.Signs(("gekürzt",), ("u a m",)), T.train([])
    assert T.inspect("Ein Text [gekürzt]", weights, {}, own) == ("mark", None) and T.inspect("Ein Text. [gekürzt]", weights, {}, T.Signs())[0] != "mark"
    assert T.inspect("Eins. u a m...", weights, {}, own) == ("whole", None)
    rows = [(i, "The team reads the rest of it. " * (i + 1) + ("[gekürzt]" if i == 3 else ""), "s") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["doc_id"] for r in T.truncated(df, doc="doc_id", text="text", source="source", marks=("gekürzt",)).where("how = 'mark'").collect()] == [3]
    assert T.Signs((), ()).sure.search("x [more]") is None


@pytest.mark.parametrize("measure, change", [("html", lambda t: t.replace("&", "&amp;")), ("crlf", lambda t: t.replace("\n", "\r\n")), ("json", lambda t: t.replace('"', '\\"'))])
def test_hidden_encodings(spark, measure, change):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        text = "".join(rng.choice(["word ", "word & ", "a\n", 'say "x" ']) if measure != "html" else rng.choice(["word ", "a & ", "b "]) for _ in range(rng.randint(20, 60)))
        if measure != "json":
            text = text.replace('"', "")
        if measure != "crlf":
            text = text.replace("\n", " ")
        while len(change(text)) > 200:
            text = text[:-1]
        rows.append((i, text, "s"))
    got = T.field_limits(spark.createDataFrame(rows, "d int, text string, source string"), source="source", text="text").first()
    assert got["measure"].startswith(measure) and got["limit"] == 200


# -- scanned pages ----------------------------------------------------------------------------------------------------
PAGE = "block_id long, file_path string, page_index int, x float, y float, height float, text string, normalized_text string, read_at timestamp, role string, noise string"


def page_blocks(spark):
    rows, n = [], 0
    base = "the catalogue keeps every measurement and the reader can compare the nested columns of the cross-page table"

    def add(page, y, h, text, norm=None, file="f", read=0):
        nonlocal n
        n += 1
        rows.append((n, file, page, 72.0, float(y), float(h), text, norm, datetime(2025, 1, 1, 0, page, read), "Body", "x"))
        return n

    keys = {}
    for p in range(6):
        keys[f"head{p}"] = add(p, 30, 10, f"Annual report   {p + 3}")
        for k in range(4):
            add(p, 100 + 60 * k, 48, base)
        keys[f"num{p}"] = add(p, 764, 9, f"- {p + 3} -")
    keys["hyphen"] = add(6, 100, 48, "the cata-\nlogue keeps every measurement")
    keys["soft"] = add(6, 160, 48, "every measure¬\nment of the table")
    keys["compound"] = add(6, 220, 48, "the cross-\npage table")
    keys["normalized"] = add(6, 280, 48, None, "the mea- surement of the table")
    keys["misread"] = add(6, 340, 48, "tlie catalogue keeps every rneasurement")
    keys["ligature"] = add(6, 400, 48, "the ﬁ rst")
    keys["end"] = add(6, 460, 48, "the reader can com-")
    keys["next"] = add(7, 100, 48, "pare the nested columns.")
    keys["value"] = add(7, 300, 11, "36")
    keys["none"] = add(7, 350, 11, None)
    df = spark.createDataFrame(rows + [(None, *rows[0][1:]), rows[0]], PAGE)
    return keys, df


def test_page_noise(spark):
    keys, df = page_blocks(spark)
    got = {}
    for r in O.page_noise(df).collect():
        got.setdefault(r["noise"], []).append(r["block_id"])
    assert sorted(got["running"]) == sorted(v for k, v in keys.items() if k.startswith(("head", "num")))
    assert sorted(got["hyphen"]) == sorted(keys[k] for k in ("hyphen", "soft", "normalized", "end"))
    assert got["misread"] == [keys["misread"]]
    assert O.page_noise(df.limit(0)).count() == 0


def test_misread_by_the_word_before(spark):
    """Both words are common, so only the word before tells which was meant."""
    texts = ["the modern table"] * 20 + ["a modem line"] * 10 + ["The modem table"] + ["every modem"]
    rows = [(i, f"f{i % 3}", i // 3, 72.0, 300.0, 48.0, t, None, datetime(2025, 1, 1), "Body", "x") for i, t in enumerate(texts)]
    got = {(r["block_id"], r["noise"]) for r in O.page_noise(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {(30, "misread")}


def test_paragraph_numbers(spark):
    """A file's first block opens a paragraph even in lower case; numbers go on over pages."""
    rows = [(i, "f", p, 72.0, y, 48.0, t, None, datetime(2025, 1, 1), "Body", "x") for i, (p, y, t) in enumerate([(0, 200.0, "starts low"), (0, 300.0, "Second one"), (1, 200.0, "goes on"), (1, 300.0, "Third"), (3, 200.0, "Fourth"), (3, 300.0, "and its end")])]
    got = [(r["paragraph"], r["text"], r["blocks"]) for r in O.repaired_paragraphs(spark.createDataFrame(rows, PAGE)).orderBy("paragraph").collect()]
    assert got == [(0, "starts low", 1), (1, "Second one goes on", 2), (2, "Third", 1), (3, "Fourth and its end", 2)]


def test_paragraphs(spark):
    _, df = page_blocks(spark)
    text = "\n".join(r["text"] for r in O.repaired_paragraphs(df).collect())
    assert "Annual report" not in text and "tlie" not in text and "rneasurement" not in text and "¬" not in text
    assert "the catalogue keeps every measurement" in text and "cross-page table" in text and "the reader can compare the nested columns." in text
    assert O.repaired_paragraphs(df.limit(0)).count() == 0


def test_skeleton(spark):
    pairs = [("modern", "modem"), ("clear", "dear"), ("table", "tab1e"), ("index", "!ndex"), ("file", "fi1c"), ("reader", "rcader")]
    df = spark.createDataFrame(pairs, "a string, b string").select((O.skeleton(F.col("a")) == O.skeleton(F.col("b"))).alias("same"))
    assert all(r["same"] for r in df.collect())


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    class Seen(Exception):
        pass

    def train(texts):
        raise Seen(texts)

    monkeypatch.setattr(T, "train", train)
    rows = [(20 * i + j, f"The text of number {i} ends here.", "s") for i in range(6) for j in range(20)]
    docs = spark.createDataFrame(rows, "d long, t string, s string")
    with pytest.raises(Seen) as seen:
        T.truncated(docs, doc="d", text="t", source="s", sample_docs=5)
    assert len(set(seen.value.args[0])) == len(seen.value.args[0]) == 5
    assert T.SAMPLE_DOCS == 4000
