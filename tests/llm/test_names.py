"""Names: tokens, similarities, clusters; nulls, repeats, ties and empty tables."""

import random

import pytest

from folioframe.llm import names as N
from folioframe.stash import Stash

SCHEMA = "entity_id string, entity_type string, name string, kind string"


def pairs(spark, rows):
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in rows], SCHEMA)
    return {(r["id_a"], r["id_b"]) for r in N.linked_pairs(N.link_names(df, id_col="entity_id", kind_col="entity_type")).collect()}


@pytest.mark.parametrize("a, b, d", [("abc", "abc", 0), ("abcd", "abdc", 1), ("abc", "abbc", 1), ("abc", "ac", 1), ("abc", "xbz", 2), ("a", "abcd", 2)])
def test_osa(a, b, d):
    assert N.osa(a, b) == d


def test_parse():
    assert N.parse("Dr. Doe, Jane, PhD", "person") == (["jane", "doe"], "")
    assert N.parse("doe j.", "person") == (["doe", "j."], "")
    assert N.parse("The Foo & Bar G.m.b.H.", "organization") == (["foo", "bar"], "gmbh")
    assert N.parse("foo-rail engineering société anonyme", "organization") == (["foo", "rail", "engineering"], "sa")
    assert N.parse("...", "person") == ([], "")


def test_given_names():
    df = {"gabriel": 50, "gabriela": 60, "robert": 300, "robetr": 4}
    assert N.given_similarity("gabriel", "gabriela", df) == 0.0
    assert N.given_similarity("robert", "robetr", df) == 0.9
    assert N.given_similarity("bob", "robert", df) == 0.95 and N.given_similarity("rob.", "robert", df) == 0.95
    assert N.given_similarity("r.", "bob", df) == 0.8 and N.given_similarity("x", "robert", df) == 0.0
    assert N.abbreviates("intl", "international") and N.abbreviates("hse", "house") and not N.abbreviates("med", "data")


def test_bands_follow_the_collision_curve():
    for s, r in ((0.55, 5), (0.7, 3)):
        b = N.bands_for(0.98, s, r)
        assert 1 - (1 - s**r) ** b >= 0.98 > 1 - (1 - s**r) ** (b - 1)


def grams(word):
    padded = f"\x02{word}\x03"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def slips_of(word, rng, letters="abcdefghijklmnopqrstuvwxyz"):
    i = rng.randrange(len(word) - 1)
    return {"exchange": word[:i] + word[i + 1] + word[i] + word[i + 2 :], "other": word[:i] + rng.choice(letters) + word[i + 1 :], "double": word[:i] + word[i] + word[i:], "drop": word[:i] + word[i + 1 :]}


@pytest.mark.parametrize("size", range(3, 19))
def test_schemes_cover_every_slip(size):
    """The curve promises RECALL at the similarity a slip really leaves, for words of any length."""
    rng = random.Random(size)
    for _ in range(50):
        word = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", size))
        for slip in slips_of(word, rng).values():
            if slip == word or min(len(slip), len(word)) < 3:
                continue
            a, b = grams(word), grams(slip)
            jaccard = len(a & b) / len(a | b)
            for more in (0, 1):
                shared = set(N.schemes(len(word), more=more)) & set(N.schemes(len(slip), more=more))
                assert max(1 - (1 - jaccard**r) ** n for _, r, n in shared) >= N.RECALL - 1e-9


@pytest.mark.parametrize("size, letters", [(n, "abcdefghijklmnopqrstuvwxyz") for n in (3, 4, 5, 6, 7, 8, 10, 13, 17)] + [(3, "".join(chr(0x4E00 + 7 * i) for i in range(300)))])
def test_alike_tokens_recall(spark, size, letters):
    """Measured recall of slips in short, long and Chinese words that stand in no list."""
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(size)) for _ in range(400)}
    slips = {s for w in words for s in slips_of(w, rng, letters).values()}
    every = sorted({t for t in words | slips if len(t) >= 3} | {"muller", "mueller"})
    got = {(r["a"], r["b"]) for r in N.alike_tokens(spark.createDataFrame([(t,) for t in every], "token string")).collect()}
    assert all(a < b and N.alike(a, b) for a, b in got) and ("mueller", "muller") in got
    near = {}
    for t in every:  # brute force by deletions, which words one slip apart always share
        for key in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}:
            near.setdefault(key, set()).add(t)
    want = {(a, b) for ts in near.values() for a in ts for b in ts if a < b and N.osa(a, b) == 1}
    assert len(want & got) >= 0.985 * len(want)


def test_crowded_bands_lose_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(5)) for _ in range(150)]
    tokens = spark.createDataFrame([(t,) for t in words], "token string")
    links = lambda block: {tuple(r) for r in N.alike_tokens(tokens, block=block).collect()}
    assert links(4) == links(10**6) != set()


PEOPLE = [
    *[(f"{g} {s}", "Person") for s in ("skarvendal", "brumholtz", "tivanescu", "okonwefu", "lindqvaster", "marovicek") for g in ("robert", "margaret", "oliver")],
]


def test_persons(spark):
    rows = PEOPLE + [
        ("bob skarvendal", "Person"), ("skarvendal, robert", "person"), ("dr. robert skarvendal", "Person"), ("robert skravendal", "Person"), ("m. brumholtz", "Person"), ("peggy brumholtz", "Person"),
        ("oliver t. tivanescu", "Person"), ("xaver skarvendal", "Person"), ("karvel engine", "Technology"), (None, "Person"), (" ", "Person"), ("robert skarvendal", "Person"), ("robert skarvendal", "Concept"),
    ]
    robert = {"robert skarvendal", "bob skarvendal", "skarvendal, robert", "dr. robert skarvendal", "robert skravendal"}
    margaret = {"margaret brumholtz", "m. brumholtz", "peggy brumholtz"}
    want = {(a, b) for g in (robert, margaret, {"oliver tivanescu", "oliver t. tivanescu"}) for a in g for b in g if a < b}
    assert pairs(spark, rows) == want


def test_slips_in_short_surnames(spark):
    rows = [(f"{g} {s}", "Person") for s in ("smith", "kent", "fuchs") for g in ("robert", "margaret", "oliver")]
    slips = {"robert smiht": "robert smith", "oliver kemt": "oliver kent", "margaret fuch": "margaret fuchs"}
    assert pairs(spark, rows + [(s, "Person") for s in slips]) == {tuple(sorted(p)) for p in slips.items()}


def test_splitting_common_surnames_loses_no_link(spark):
    rows = PEOPLE + [(n, "Person") for n in (
        "bob skarvendal", "skarvendal, robert", "robert skravendal", "eobert skarvendal", "orbert skarvendal", "obert skarvendal", "rob. brumholtz", "m. brumholtz", "peg. brumholtz", "peggy brumholtz", "bob. tivanescu",
        "r. okonwefu", "rh okonwefu", "oliver lindqvasetr", "ollie lindqvaster",
    )]
    df = spark.createDataFrame(rows, "entity_id string, entity_type string")
    links = lambda common: {tuple(r) for r in N.linked_pairs(N.link_names(df, id_col="entity_id", kind_col="entity_type", common=common)).collect()}
    want = links(10**9)
    assert ("robert skarvendal", "robert skravendal") in want and ("eobert skarvendal", "robert skarvendal") in want
    assert links(2) == want


def test_splitting_common_organisation_names_loses_no_link(spark):
    rows = [(f"{w} {k}", "Organization") for w in ("tralvonik", "bessolund", "kolmerstag") for k in ("rail engineering gmbh", "paper mills", "data systems ltd", "food", "foods inc", "rail eng.", "pm")]
    rows += [("tralvonik", "Organization"), ("bessolund gmbh", "Organization"), ("tralvonki food", "Organization"), ("mills paper kolmerstag", "Organization")]
    df = spark.createDataFrame(rows, "entity_id string, entity_type string")
    links = lambda common: {tuple(r) for r in N.linked_pairs(N.link_names(df, id_col="entity_id", kind_col="entity_type", common=common)).collect()}
    want = links(10**9)
    assert ("tralvonik food", "tralvonki food") in want and ("kolmerstag paper mills", "mills paper kolmerstag") in want
    assert links(1) == want


def test_a_proper_name_stays_a_key_whatever_its_spellings(spark):
    words = ["rail", "paper", "data", "food", "steel", "glass", "wood", "cargo", "solar", "hydro"]
    many = [f"tralvonik {a} {b}" for a in words for b in words if a != b]
    rows = [(n, "Organization") for n in [*many, "tralvonik rail hydros", *(f"{x} rail" for x in ("bessolund", "kolmerstag", "unterweg"))]]
    assert ("tralvonik rail hydro", "tralvonik rail hydros") in pairs(spark, rows)


def test_short_and_chinese_names(spark):
    rows = PEOPLE + [(n, "Person") for n in ("anna wolf", "anna wofl", "oliver wolf", "john kim", "john kmi", "mary kim", "li wu", "wu li", "王伟", "王 伟", "张丽", "欧阳锋", "欧 阳锋")]
    want = {("anna wofl", "anna wolf"), ("john kim", "john kmi"), ("li wu", "wu li"), ("王 伟", "王伟"), ("欧 阳锋", "欧阳锋")}
    assert pairs(spark, rows) == want


def test_own_nicknames(spark):
    df = spark.createDataFrame([(n, t) for n, t in PEOPLE + [("quim skarvendal", "Person"), ("joaquim skarvendal", "Person")]], "entity_id string, entity_type string")
    found = lambda **k: {tuple(r) for r in N.linked_pairs(N.link_names(df, id_col="entity_id", kind_col="entity_type", **k)).collect()}
    assert found() == set() and found(nicknames={"joaquim": "quim"}) == {("joaquim skarvendal", "quim skarvendal")}
    assert found(nicknames={}) == set()


def test_ambiguous_initials_stay_alone(spark):
    rows = PEOPLE + [("rebecca brumholtz", "Person"), ("r. brumholtz", "Person"), ("brumholtz, r.", "Person")]
    assert pairs(spark, rows) == {("brumholtz, r.", "r. brumholtz")}


def test_organizations(spark):
    rows = [
        ("tralvonik rail engineering gmbh", "Organization"), ("tralvonik rail eng. g.m.b.h.", "Organization"), ("tralvonik re", "Organization"), ("tralvonik", "Organization"), ("rail engineering, tralvonik", "organization"),
        ("bessolund paper mills ltd", "Organization"), ("bessolund data systems ltd", "Organization"), ("bessolund", "Organization"), ("bessolund paper mills inc", "Organization"),
        ("kolmerstag rail engineering sa", "Organization"),
    ]
    one = {r[0] for r in rows[:5]}
    assert pairs(spark, rows) == {(a, b) for a in one for b in one if a < b}


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("solo name", "Person"), ("none", None)]) == set()


def test_star_clusters_match_the_greedy_order(spark):
    rng = random.Random(4)
    for _ in range(3):
        ids = [f"n{i:02}" for i in range(25)]
        rank = {i: rng.randint(0, 5) for i in ids}
        edges = {(a, b): rng.choice([0.8, 0.9, 1.0]) for a in ids for b in ids if a < b and rng.random() < 0.12}
        both = {**edges, **{(b, a): s for (a, b), s in edges.items()}}
        centres = []
        for i in sorted(ids, key=lambda i: (rank[i], i), reverse=True):
            if all((i, c) not in both for c in centres):
                centres.append(i)
        want = {i: i if i in centres else max((both[i, c], rank[c], c) for c in centres if (i, c) in both)[2] for i in ids}
        nodes = spark.createDataFrame([(i, (rank[i],)) for i in ids], "id string, rank struct<r:int>")
        df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, similarity double")
        assert {r["id"]: r["star"] for r in N.star_clusters(nodes, df, Stash(spark)).collect()} == want
