"""Variant spellings of names typed by people.

Steps: names are cut into tokens; the sets of padded letter pairs of the tokens are MinHashed, and tokens that share a
band of hashes are candidates for a typing slip, which edit distance confirms. Rows and bands follow the length of a
token: they are taken from the collision curve, so that the least similarity a slip leaves at that length is found
with probability ``RECALL``. Equal tokens share all bands. Names that share an equal or alike distinctive token are
candidates; a candidate pair is verified by Monge-Elkan similarity of its tokens, with an inner similarity that knows
typing slips, abbreviations, initials and nicknames; verified pairs are clustered by star clustering, in which
incomplete spellings join a star only if it is the only one they fit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioframe.operators.skew import meetings
from folioframe.stash import Stash

#: Probability with which banding brings together two tokens that a slip of any kind sets apart.
RECALL = 0.99
# Common short forms of given names, the default of ``link_names``; a table of one's own may be passed.
NICKNAMES = {
    "abigail": "abby", "adelaide": "addie", "agnes": "nessie", "albert": "al bert bertie", "alexander": "alex al sandy sasha xander",
    "alexandra": "alex sandra lexi", "alfred": "alf fred", "amanda": "mandy", "andreas": "andi", "andrew": "andy drew", "angela": "angie",
    "anthony": "tony", "antonio": "toni tonio", "archibald": "archie", "arthur": "art artie", "barbara": "barb babs", "bartholomew": "bart",
    "beatrice": "bea trixie", "benjamin": "ben benji benny", "bernard": "bernie", "bradley": "brad", "caroline": "carrie caro", "cassandra": "cassie",
    "catherine": "cathy cate", "cecilia": "cece", "charles": "charlie chuck", "charlotte": "lottie charlie lotte", "christine": "chris chrissy tina",
    "christopher": "chris", "clifford": "cliff", "constance": "connie", "cornelius": "neil", "cynthia": "cindy", "daniel": "dan danny",
    "david": "dave davy", "deborah": "deb debbie", "dennis": "denny", "diana": "di", "dmitri": "dima mitya", "dominic": "dom nick",
    "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ned ted eddie ed", "ekaterina": "katya",
    "eleanor": "ellie nell nora", "elizabeth": "beth liz betty eliza lizzie", "emanuel": "manny", "ernest": "ernie", "eugene": "gene",
    "evgeny": "zhenya", "ferdinand": "ferdi", "florence": "flo", "francesca": "fran chessa franny", "francis": "frank",
    "francisco": "paco pancho fran", "franziska": "franzi", "frederick": "fred freddie", "friedrich": "fritz", "gabriel": "gabe",
    "gerald": "gerry jerry", "geraldine": "gerry", "gertrude": "trudy", "gilbert": "gil", "giuseppe": "beppe peppe pino", "gregory": "greg",
    "guadalupe": "lupe lupita", "gwendolyn": "gwen", "harold": "harry hal", "helen": "nell", "henrietta": "hettie etta", "henry": "hank harry",
    "herbert": "herb bert", "ignacio": "nacho", "ingeborg": "inge", "irina": "ira", "isabel": "izzy bella isa", "ivan": "vanya", "jacob": "jake",
    "jacqueline": "jackie", "james": "jim jimmy", "jeffrey": "jeff", "jennifer": "jen jenny", "jeremy": "jerry", "jessica": "jess jessie",
    "joanna": "jo asia", "johannes": "hannes jo hans", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "josef": "sepp",
    "joseph": "joe joey", "josephine": "jo josie", "judith": "judy", "juliana": "jules", "katherine": "kate kathy katie kat", "kenneth": "ken kenny",
    "konstantin": "kostya", "lawrence": "larry laurie", "leonard": "len lenny", "leopold": "leo", "louis": "lou", "lucille": "lucy", "ludwig": "lutz",
    "magdalena": "magda lena", "malgorzata": "gosia", "marcus": "marc", "margaret": "peggy meg maggie", "maria": "masha mia", "martha": "marty",
    "martin": "marty", "matthew": "matt", "maximilian": "max", "melanie": "mel", "melissa": "missy", "michael": "mike mick", "mikhail": "misha",
    "mildred": "millie", "mitchell": "mitch", "nathaniel": "nat nate", "nicholas": "nick", "nikolai": "kolya nik", "norman": "norm", "olga": "olya",
    "oliver": "ollie", "pamela": "pam", "patricia": "pat patty", "penelope": "penny", "peter": "pete", "philip": "phil", "philippa": "pippa",
    "priscilla": "cilla", "raymond": "ray", "rebecca": "becky", "reginald": "reggie", "richard": "rick dick rich", "robert": "bob rob bobby",
    "roberta": "bobbie", "roland": "rolly", "ronald": "ron ronnie", "rosalind": "roz", "rudolf": "rudi", "russell": "russ", "samuel": "sam sammy",
    "sergei": "seryozha", "sigmund": "sigi", "solomon": "sol", "stanislaw": "staszek", "stanley": "stan", "stephen": "steve", "susan": "sue",
    "susanna": "suzy", "svetlana": "sveta", "sylvester": "sly", "tatiana": "tanya", "terence": "terry", "teresa": "terry tess",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "tomasz": "tomek", "ulrike": "uli", "ursula": "uschi",
    "valentina": "valya", "veronica": "ronnie vera", "victoria": "vicky tori", "viktor": "vitya vik", "vincent": "vince", "virginia": "ginny",
    "vladimir": "volodya vova", "walter": "walt wally", "wilhelmina": "mina willa", "william": "will bill billy", "wolfgang": "wolf",
    "yevgenia": "zhenya", "zacharias": "zach", "zachary": "zach zack", "zsofia": "zsofi",
}
# Titles and degrees, legal forms, words that carry no identity.
TITLES = {"dr", "prof", "phd", "mr", "mrs", "ms", "sir", "jr", "sr", "md", "ing", "dipl"}
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "sa": "sa",
    "plc": "plc", "llc": "llc", "ag": "ag", "company": "co", "group": "group", "holding": "group",
}
PHRASES = (
    (r"g\.\s?m\.\s?b\.\s?h\.", "gmbh"), (r"gesellschaft mbh", "gmbh"), (r"gesellschaft mit beschränkter haftung", "gmbh"), (r"\bs\.\s?a\.", "sa"),
    (r"société anonyme", "sa"), (r"\bl\.\s?l\.\s?c\.", "llc"), (r"\bco-op\b", "cooperative"), (r"&", " and "),
)
FILLERS = {"the", "and", "of", "de", "der", "die", "und", "et", "for"}
_HAN = "\u3400-\u9fff"


def full_forms(nicknames: dict[str, str]) -> dict[str, set[str]]:
    """The full forms of each short form, of full form -> short forms separated by blanks."""
    out: dict[str, set[str]] = {}
    for full, shorts in nicknames.items():
        for short in shorts.split():
            out.setdefault(short, set()).add(full)
    return out


_FULL = full_forms(NICKNAMES)


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


def parse(name: str, kind: str) -> tuple[list[str], str]:
    """Tokens in reading order (``S, F`` is turned to ``F S``) and the legal form; a token that ended in a dot keeps it."""
    text = re.sub(f"(?<=[{_HAN}])\\s+(?=[{_HAN}])", "", " ".join(name.lower().split()))  # blanks mean nothing between Han characters
    if kind == "organization":
        for pattern, plain in PHRASES:
            text = re.sub(pattern, plain, text)
        tokens = re.findall(r"[\w']+\.?", fold(text))
        legal = [LEGAL[t.rstrip(".")] for t in tokens if t.rstrip(".") in LEGAL]
        rest = [t for t in tokens if t.rstrip(".") not in LEGAL and t not in FILLERS]
        return (rest or tokens), next((x for x in legal if x != "group"), "")
    parts = [p for p in (re.findall(r"[\w'-]+\.?", fold(p)) for p in text.split(",")) if p]
    parts = [[t for t in p if t.rstrip(".") not in TITLES] for p in parts]
    parts = [p for p in parts if p]
    if not parts:
        return re.findall(r"[\w'-]+\.?", fold(text)), ""
    return [t for p in [*parts[1:], parts[0]] for t in p], ""


def osa(a: str, b: str, most: int = 1) -> int:
    """Edit distance with transpositions of neighbours, most + 1 if larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    back, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if back and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, back[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        back, row = row, now
    return min(row[-1], most + 1)


def alike(a: str, b: str) -> bool:
    """One typing slip apart, umlauts spelled out counting as none."""
    if osa(a, b) <= 1:
        return True
    return _plain(a) != a and _plain(a) == b or _plain(b) != b and a == _plain(b)


def abbreviates(short: str, full: str) -> bool:
    """``med.`` medical, ``intl`` international, ``hse`` house: same first letter, letters in order, clearly shorter."""
    short = short.rstrip(".")
    if not 2 <= len(short) <= len(full) - 2 or short[0] != full[0]:
        return False
    at = iter(full)
    return all(c in at for c in short)


def bands_for(recall: float, similarity: float, rows: int) -> int:
    """Bands needed so that sets of this Jaccard similarity collide with at least this probability: 1 - (1 - s ** r) ** b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def schemes(size: int, recall: float = RECALL, more: int = 0) -> list[tuple[int, int, int]]:
    """(name, rows, bands) of the bands a token of ``size`` letters takes part in.

    With one pad on either side a word of n letters has n + 1 pairs of letters. Two neighbours exchanged leave n - 2 of n + 4
    pairs equal, the least a slip within one length leaves; a letter dropped from n leaves n - 1 of n + 2. Tokens one
    slip apart share a scheme, that of their length or that of the longer one. More rows make shorter candidate lists
    and need more bands, so short words have few; ``more`` rows are added for large vocabularies, and the bands they need, so
    the recall stays. From 14 letters on the curve of 14 holds, words being more similar then.
    """
    out = []
    for name, n, left, of in ((1000 + size, size, size - 2, size + 4), (size, size, size - 1, size + 2), (size + 1, size + 1, size, size + 3)):
        if n < 3:
            continue
        left, of = (left, of) if n <= 14 else ((12, 18) if name >= 1000 else (13, 16))
        rows = more + (1 if n == 3 else 2 if n <= 6 else 3 if n <= 9 else 4)
        out.append((name, rows, bands_for(recall, left / of, rows)))
    return out


def _plain(token: str) -> str:
    """Spelled-out umlauts as the bare vowel."""
    return token.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (multiply and shift) that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(words: list[str], rows: int, bands: int, name: int) -> np.ndarray:
    """Words x bands: a hash of ``rows`` MinHashes of the padded letter pairs of each word."""
    codes = [np.frombuffer(f"\x02{w}\x03".encode("utf-32-le"), np.uint32).astype(np.uint64) for w in words]
    grams = np.concatenate([(c[:-1] << np.uint64(32)) | c[1:] for c in codes])
    starts = np.cumsum([0, *(len(c) - 1 for c in codes[:-1])])
    seeds = _mixed(np.arange(1, rows * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.empty((len(words), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(words), name * 4096 + band, np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(_mixed(grams ^ seeds[band * rows + row]), starts)
            key = _mixed(key ^ least)
        keys[:, band] = key
    return keys.view(np.int64)


def _banded(recall: float, more: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            forms: dict[tuple[int, int, int], list[tuple[str, str]]] = {}
            for token in part["token"]:
                for form in {token, _plain(token)}:
                    for scheme in schemes(len(form), recall, more):
                        forms.setdefault(scheme, []).append((token, form))
            for (name, rows, bands), words in forms.items():
                keys = band_keys([f for _, f in words], rows, bands, name)
                yield pd.DataFrame({"token": np.repeat([t for t, _ in words], bands), "band": keys.ravel()})

    return run


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over all shuffle partitions, before Python work that costs more than its few bytes tell AQE."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def alike_tokens(tokens: DataFrame, stash: Stash | None = None, *, recall: float = RECALL, block: int = 1024) -> DataFrame:
    """Pairs of distinct tokens (a < b) one typing slip apart, of ``tokens`` (token), each found with probability ``recall`` at least.

    A letter dropped, added or replaced, or two neighbours exchanged, in tokens of three letters and more (a pair of two and
    three letters is found by the scheme of three). Tokens of a crowded band are met in chunks, all of them.
    """
    stash = stash or Stash(tokens.sparkSession)
    tokens, size = stash.put_counted(tokens.distinct())
    more = max(0, math.ceil(math.log(max(size, 1) / 100_000, 100)))  # a row parts buckets about a hundredfold
    banded = stash.put(spread(tokens, "token").mapInPandas(_banded(recall, more), "token string, band bigint"))
    met = [x.alias("a").join(y.alias("b"), on).where(F.col("a.token") < F.col("b.token")).select(F.col("a.token").alias("a"), F.col("b.token").alias("b")) for x, y, on in meetings(banded, "band", "token", block)]
    near = reduce(DataFrame.unionByName, met).distinct()
    # two edits are one exchange at most; what is farther apart is no slip, unless umlauts are spelled out
    near = near.where((F.levenshtein("a", "b", 2) >= 0) | F.concat("a", "b").rlike("[aou]e"))

    @F.pandas_udf("boolean")
    def slip(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(i, j) for i, j in zip(x, y)], dtype=bool)

    return near.where(slip("a", "b"))


def _givens(token: str, full: dict[str, set[str]]) -> set[str]:
    return full.get(token.rstrip("."), {token.rstrip(".")}) | {token.rstrip(".")}


def given_similarity(a: str, b: str, df: dict[str, int], full: dict[str, set[str]] = _FULL) -> float:
    """Similarity of two given-name tokens: 1 equal, 0.95 short form, 0.9 slip, 0.8 initial, 0 different.

    Two tokens one slip apart are the same name only if one is much rarer: ``gabriel`` and ``gabriela`` are both
    common, so neither is a slip of the other. A last letter more or less is a slip only if it is rarer still.
    """
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        one, other = (x, b) if len(x) == 1 else (y, a)
        return 0.8 if any(g.startswith(one) for g in _givens(other, full)) else 0.0
    fx, fy = _givens(x, full), _givens(y, full)
    if fx & fy:
        return 0.95
    for short, s, forms in ((a, x, fy), (b, y, fx)):
        if len(s) >= 3 and short.endswith(".") and any(f.startswith(s) and f != s for f in forms):
            return 0.95
    few, many = sorted((df.get(x, 1), df.get(y, 1)))
    if min(len(x), len(y)) >= 3 and osa(x, y) <= 1:
        longer, shorter = (x, y) if len(x) > len(y) else (y, x)
        ratio = 8 if longer[:-1] == shorter else 3
        return 0.9 if many >= ratio * few or (many == few == 1 and ratio == 3) else 0.0
    return 0.0


def _initials(rest: list[str], full: dict[str, set[str]]) -> list[str]:
    """``rh`` (two initials typed together) becomes ``r h``."""
    if len(rest) == 1 and len(rest[0].rstrip(".")) == 2 and rest[0].rstrip(".") not in full:
        return list(rest[0].rstrip("."))
    return rest


def monge_elkan(a: list, b: list, inner: Callable[[object, object], float]) -> float:
    """Mean over ``a`` of the best inner similarity to any of ``b``; 0 if either is empty."""
    return sum(max(inner(x, y) for y in b) for x in a) / len(a) if a and b else 0.0


def person_similarity(rest_a: list[str], rest_b: list[str], df: dict[str, int], full: dict[str, set[str]] = _FULL) -> tuple[float, bool, bool]:
    """Monge-Elkan similarity of what is left beside the common surname, and whether each side has a full given name.

    Names are compared place by place, first to first, as ``john robert`` and ``robert`` are two persons; a middle name
    only one side has says nothing, two different ones tell the names apart.
    """
    a, b = _initials(rest_a, full), _initials(rest_b, full)
    if not a or not b:
        return 0.0, bool(a), bool(b)

    def inner(x: tuple[int, str], y: tuple[int, str]) -> float:
        if x[0] != y[0]:
            return 0.0
        if not x[0]:
            return given_similarity(x[1], y[1], df, full)
        m, n = x[1].rstrip("."), y[1].rstrip(".")
        return 1.0 if m == n else 0.8 if (len(m) == 1 or len(n) == 1) and m[0] == n[0] else 0.0

    both = min(len(a), len(b), 2)
    s, t = list(enumerate(a[:both])), list(enumerate(b[:both]))
    apart = any(not inner(x, y) for x, y in zip(s, t))
    return (0.0 if apart else monge_elkan(s, t, inner)), len(a[0].rstrip(".")) > 1, len(b[0].rstrip(".")) > 1


def _word(a: str, b: str) -> float:
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0
    if abbreviates(x, y) or abbreviates(y, x):
        return 0.95
    return 0.9 if min(len(x), len(y)) >= 4 and osa(x, y) <= 1 else 0.0


def organization_similarity(rest_a: list[str], rest_b: list[str], legal_a: str, legal_b: str) -> tuple[float, bool, bool]:
    """The same for organisations: what they do, beside the common proper name."""
    full_a, full_b = bool(rest_a), bool(rest_b)
    if legal_a and legal_b and legal_a != legal_b:
        return 0.0, full_a, full_b
    if not full_a or not full_b:
        return (0.8 if full_a or full_b else 0.95), full_a, full_b
    for s, t in ((rest_a, rest_b), (rest_b, rest_a)):
        if len(s) == 1 and len(t) > 1 and s[0].rstrip(".") == "".join(x[0] for x in t):
            return 0.95, full_a, full_b
    return min(monge_elkan(rest_a, rest_b, _word), monge_elkan(rest_b, rest_a, _word)), full_a, full_b


def _verify(threshold: float, full: dict[str, set[str]]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for a, b, kind, ta, tb, la, lb, da, db, wa, wb in zip(*(part[c] for c in ("a", "b", "kind", "tok_a", "tok_b", "legal_a", "legal_b", "df_a", "df_b", "key_a", "key_b"))):
                rest_a, rest_b = [t for t in ta if t.rstrip(".") != wa], [t for t in tb if t.rstrip(".") != wb]
                if sorted(t.rstrip(".") for t in ta) == sorted(t.rstrip(".") for t in tb) and not (la and lb and la != lb):
                    s, fa, fb = 1.0, bool(rest_a), bool(rest_b)  # the same words in any order
                    if kind != "organization":
                        fa = fb = not rest_a or any(len(t.rstrip(".")) > 1 for t in rest_a)
                elif kind == "organization":
                    s, fa, fb = organization_similarity(rest_a, rest_b, la, lb)
                else:
                    df = {t.rstrip("."): int(n) for ts, ns in ((ta, da), (tb, db)) for t, n in zip(ts, ns)}
                    s, fa, fb = person_similarity(rest_a, rest_b, df, full)
                    if wa != wb and s and s < 0.95 and fa and fb:
                        s = 0.0  # a slip in both parts is another name
                if s >= threshold:
                    out.append((a, b, s, fa, fb))
            yield pd.DataFrame(out, columns=["a", "b", "similarity", "full_a", "full_b"])

    return run


def star_clusters(nodes: DataFrame, edges: DataFrame, stash: Stash) -> DataFrame:
    """Star clustering of ``nodes`` (id, rank struct, greater is better) by ``edges`` (a, b, similarity): (id, star).

    In rounds, an open node that ranks above all its open neighbours becomes a centre and its open neighbours its
    satellites; at the end a satellite belongs to its most similar centre. Nodes without edges are their own star.
    """
    both = stash.put(edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")))
    linked = stash.put(nodes.join(both.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
    open_, centres = linked, None
    while True:
        if open_.isEmpty():
            break
        live = both.join(open_.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(open_.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b")
        beaten = live.where(F.struct("rank_b", "b") > F.struct("rank_a", "a")).select(F.col("a").alias("id")).distinct()
        fresh = stash.put(open_.join(beaten, "id", "left_anti").select("id"))
        centres = fresh if centres is None else centres.unionByName(fresh)
        taken = both.join(fresh.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).unionByName(fresh).distinct()
        open_ = stash.put(open_.join(taken, "id", "left_anti"))
    if centres is None:
        return nodes.select("id", F.col("id").alias("star"))
    centres = stash.put(centres)
    best = (
        both.join(centres.withColumnRenamed("id", "b"), "b", "left_semi")
        .join(centres.withColumnRenamed("id", "a"), "a", "left_anti")
        .join(linked.select(F.col("id").alias("b"), F.col("rank")), "b")
        .groupBy("a").agg(F.max(F.struct("similarity", "rank", "b")).alias("m"))
        .select(F.col("a").alias("id"), F.col("m.b").alias("star"))
    )
    starred = best.unionByName(centres.select("id", F.col("id").alias("star")))
    return nodes.join(starred, "id", "left").select("id", F.coalesce("star", "id").alias("star"))


def _parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        both = [parse(n, k) for n, k in zip(part["id"], part["kind"])]
        yield part.assign(tokens=[t for t, _ in both], legal=[x for _, x in both])


def _candidates(rich: DataFrame, near: DataFrame, stash: Stash, full: dict[str, set[str]], common: int) -> DataFrame:
    """Pairs of names that share a key token or whose key tokens are alike: kind, a, b, ``key_a``, ``key_b``.

    A token with more than ``common`` names is combined with the first two letters of their other tokens and the
    initials of those tokens' full forms: any two tokens that ``given_similarity`` or ``_word`` accepts share one of them
    (a slip in the first letter keeps the second or exchanges them), so the links stay the same and only hopeless pairs
    are left out. An organisation's bare proper name has no other token and meets all names of the token.
    """
    keyed = rich.select("id", "kind", F.explode("keys").alias("k")).select("id", "kind", F.col("k.token").alias("token"))
    direct = keyed.select("id", "kind", "token", F.col("token").alias("via"))
    slipped = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(keyed.withColumnRenamed("token", "a"), "a")
    wide = direct.unionByName(slipped.select("id", "kind", F.col("a").alias("token"), F.col("b").alias("via")))
    # whether a key is split depends on the token both sides come by, so both are split or neither
    counts = wide.groupBy("kind", "via").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("token") == F.col("via")).alias("own"))
    counts = stash.put(counts.where("n > 1 and own > 0"))
    hot = counts.where(F.col("n") > common).select("kind", "via", F.lit(True).alias("hot"))
    wide = wide.join(counts.select("kind", "via"), ["kind", "via"], "left_semi").join(hot, ["kind", "via"], "left").join(rich.select("id", "tokens"), "id")
    rest = F.filter(F.transform("tokens", lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t != F.col("token"))
    shorts = F.create_map(*[F.lit(x) for s, forms in sorted(full.items()) for x in (s, "".join(sorted({f[0] for f in forms})))]) if full else F.create_map(F.lit(""), F.lit(""))
    letters = F.flatten(F.transform(rest, lambda t: F.split(F.concat(F.substring(t, 1, 2), F.coalesce(shorts[t], F.lit(""))), "")))
    letters = F.array_distinct(F.filter(letters, lambda c: c != ""))
    bare = F.size(rest) == 0
    parts = F.when(F.col("hot").isNull(), F.array(F.lit(""))).when(F.col("kind") == "organization", F.array_append(letters, F.lit("*"))).otherwise(letters)
    sides = wide.select("id", "kind", "token", "via", F.explode(parts).alias("part"), bare.alias("bare"))
    sides = stash.put(sides.select(F.struct("kind", "via", "part").alias("key"), "id", "token", "bare"))
    own_x, own_y, loose = F.col("x.token") == F.col("key.via"), F.col("y.token") == F.col("key.via"), F.col("key.part") == "*"
    met = []
    for x, y, on in meetings(sides, "key", "id", 1024):
        # bare names look at all of their token, others at those of the same part; one side has the token itself
        x = x.where(F.when(F.col("key.part") == "*", F.col("bare")).otherwise(F.col("token") == F.col("key.via")))
        met.append(x.alias("x").join(y.alias("y"), on).where((F.col("x.id") != F.col("y.id")) & (own_x | own_y) & (loose | ~own_y | (F.col("x.id") < F.col("y.id")))))
    first = F.col("x.id") < F.col("y.id")
    pick = lambda c, d: F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(d)
    rev = lambda c, d: F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(d)
    pairs = [m.select(F.col("key.kind").alias("kind"), pick("id", "a"), rev("id", "b"), pick("token", "key_a"), rev("token", "key_b")) for m in met]
    return reduce(DataFrame.unionByName, pairs).distinct()


def link_names(
    mentions: DataFrame, *, id_col: str, kind_col: str, threshold: float = 0.8, common: int = 500, nicknames: dict[str, str] | None = None, recall: float = RECALL
) -> DataFrame:
    """Which spellings name the same person or organisation: (``id``, ``kind``, ``star``), one row per spelling.

    ``id_col`` holds the spelling, in lower case; ``kind_col`` says person or organization in any letter case. A
    spelling's kind is the one most of its mentions have (ties: person or organization, the last in the alphabet). A
    spelling of another kind takes part only if it has a distinctive token of a person or organisation, as its type may be
    wrong; null and empty spellings are left out. Mentions only count, so a spelling with a third of all rows is one row from the first
    aggregation on. Spellings with the same ``star`` name the same entity.

    A person's key is the surname (a token that mostly doesn't come first), an organisation's any token that doesn't
    follow many different first words, as general words do (12, or 0.1 per cent of the organisations); how many
    spellings one name has plays no part. A name without such a token has all its tokens as keys, and the whole of
    them in any order. ``nicknames`` (full form -> short forms separated by blanks) stands in for ``NICKNAMES``;
    ``common`` see ``_candidates``: it doesn't change the result. ``recall`` is that of a slip's candidates, see
    ``alike_tokens``; everything after it is exact.
    """
    full = _FULL if nicknames is None else full_forms(nicknames)
    stash = Stash(mentions.sparkSession)
    counted = mentions.select(F.col(id_col).alias("id"), F.lower(F.trim(kind_col)).alias("kind")).where("id is not null and trim(id) != ''")
    counted = counted.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.col("kind").isin("person", "organization")
    every = counted.groupBy("id").agg(F.max(F.struct(F.col("n"), kinds.alias("named"), F.col("kind"))).alias("m"), F.sum("n").alias("mentions"))
    every = stash.put(every.select("id", F.col("m.kind").alias("kind"), "mentions"))
    named = every.where(kinds)
    organizations = F.lit(max(12.0, 0.001 * every.where("kind = 'organization'").count()))
    bare = lambda c: F.regexp_replace(c, r"\.$", "")
    told_by_length = lambda c: (F.length(c) > 2) | F.col(c).rlike(f"^[{_HAN}]{{2}}$")

    def words_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Tokens of names, and how many spellings of the kind have each, how often in front, and whether it tells names apart."""
        words = parsed.select("id", "kind", "mentions", "legal", bare(F.get("tokens", 0)).alias("head"), F.posexplode("tokens").alias("pos", "raw"), F.size("tokens").alias("size"))
        words = words.withColumn("token", bare(F.col("raw")))
        per_head = words.groupBy("kind", "token", "head").agg(
            F.count_distinct("id").alias("df"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("pos") == 0) & (F.col("size") > 1)).alias("front")
        )
        facts = per_head.groupBy("kind", "token").agg(
            F.sum("df").alias("df"), (F.sum("front") / F.sum("n")).alias("first"), F.count_if(F.col("head") != F.col("token")).alias("heads")
        )
        person = (F.col("first") <= 0.5) & told_by_length("token") & ~F.col("token").isin(*sorted(full))
        told = F.when(F.col("kind") == "organization", F.col("heads") <= organizations).otherwise(person)
        return words.drop("head"), stash.put(facts.withColumn("distinctive", told))

    parsed = lambda df: stash.put(spread(df, "id").mapInPandas(_parsed, "id string, kind string, mentions bigint, tokens array<string>, legal string"))
    first_names = parsed(named)
    _, facts = words_of(first_names)
    # mentions of a wrong type: a spelling of another kind that has a distinctive token of names may be one, and is compared too
    other = parsed(every.where("kind is null or not kind in ('person', 'organization')"))
    tokens = other.select("id", "mentions", F.explode("tokens").alias("token")).withColumn("token", bare(F.col("token"))).where(told_by_length("token"))
    adopted = tokens.join(facts.where("distinctive").select("kind", "token", "df"), "token").groupBy("id", "mentions").agg(F.max(F.struct(F.length("token").alias("l"), F.col("kind"))).alias("m"))
    names = stash.put(first_names.unionByName(parsed(adopted.select("id", F.col("m.kind").alias("kind"), "mentions"))))
    words, facts = words_of(names)
    joined = words.join(facts, ["kind", "token"])
    rich = joined.groupBy("id", "kind", "mentions", "legal").agg(
        F.array_sort(F.collect_list(F.struct("pos", "raw", "token", "df", "distinctive"))).alias("t")
    )
    # a name without a distinctive token is found by all of its tokens but initials, and as a whole
    rich = rich.withColumn("any", F.exists("t", lambda x: x["distinctive"]))
    whole = F.struct(F.array_join(F.array_sort("t.token"), " ").alias("token"))
    keys = F.transform(F.filter("t", lambda x: x["distinctive"] | (~F.col("any") & (F.length(x["token"]) > 2))), lambda x: F.struct(x["token"].alias("token")))
    rich = stash.put(
        rich.select("id", "kind", "mentions", "legal", F.col("t.raw").alias("tokens"), F.col("t.df").alias("df"), F.array_distinct(F.when(F.col("any"), keys).otherwise(F.array_append(keys, whole))).alias("keys"))
    )
    tokens = rich.select(F.explode("keys.token").alias("token")).where(~F.col("token").contains(" ") & (F.length("token") >= 3))
    # of three letters against three, another letter is as likely another name; two exchanged ones are not
    same_letters = F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))
    near = stash.put(alike_tokens(tokens, stash, recall=recall).where((F.greatest(F.length("a"), F.length("b")) >= 4) | same_letters))
    pairs = _candidates(rich, near, stash, full, common)
    side = lambda s: rich.select(F.col("id").alias(s), F.col("tokens").alias(f"tok_{s}"), F.col("legal").alias(f"legal_{s}"), F.col("df").alias(f"df_{s}"))
    verified = spread(pairs.join(side("a"), "a").join(side("b"), "b"), "a", "b").mapInPandas(_verify(threshold, full), "a string, b string, similarity double, full_a boolean, full_b boolean")
    verified = stash.put(verified.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("full_a").alias("full_a"), F.max("full_b").alias("full_b")))

    partial = verified.where("full_a != full_b")
    equal = verified.where("full_a = full_b")
    lacking = equal.where("not full_a").select(F.explode(F.array("a", "b")).alias("id")).unionByName(
        partial.select(F.when(F.col("full_a"), F.col("b")).otherwise(F.col("a")).alias("id"))
    ).distinct()
    # the commonest given name and spelling is the centre: slips and short forms are satellites
    weight = F.aggregate("df", F.lit(0).cast("bigint"), lambda s, n: s + n)
    dotted = F.exists("tokens", lambda t: t.endswith("."))
    ranks = rich.select("id", F.struct((~dotted).alias("plain"), weight.alias("known"), F.col("mentions")).alias("rank"))
    stars = stash.put(star_clusters(ranks, equal, stash))
    star_of = lambda c: stars.select(F.col("id").alias(c), F.col("star").alias(f"star_{c}"))
    ends = partial.select(F.when(F.col("full_a"), F.col("b")).otherwise(F.col("a")).alias("less"), F.when(F.col("full_a"), F.col("a")).otherwise(F.col("b")).alias("more"))
    fits = ends.join(star_of("less"), "less").join(star_of("more"), "more").groupBy("star_less").agg(
        F.min("star_more").alias("low"), F.max("star_more").alias("high")
    )
    moved = fits.where("low = high").select(F.col("star_less").alias("star"), F.col("low").alias("into"))
    final = stars.join(moved, "star", "left").select("id", F.coalesce("into", "star").alias("star"))
    return final.join(names.select("id", "kind"), "id").select("id", "kind", "star")


def linked_pairs(stars: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) of spellings of one star."""
    shared = stars.join(stars.groupBy("star").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("star"), "star", "left_semi")
    a, b = shared.alias("a"), shared.alias("b")
    return a.join(b, (F.col("a.star") == F.col("b.star")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
