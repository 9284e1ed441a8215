"""Noise in text from scanned pages: running headers, broken words, misread characters, and the repaired paragraphs.

Words are grouped by a confusable-glyph skeleton: every glyph is written as the strokes scanners mix up, so ``rn`` and
``m``, ``cl`` and ``d``, ``1``, ``l``, ``i`` and ``!`` fall together. Within a skeleton the form that the corpus uses
most, with the support of the word before it, is the right one. Headers are found by masking digits and comparing pages;
paragraphs are put together by SQL windows over pages and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.operators.skew import broadcast_if, lookup
from folioframe.stash import Stash

# Fixed values. Hyphens that only a typesetter puts at a line's end (hyphen, soft hyphen, not sign), and the common one.
SOFT_MARKS, HARD_MARK = "\u2010\u00ad\u00ac", "-"
#: Stands for a break within a token, hard or soft.
_HARD, _SOFT = "\ue000", "\ue001"
# Glyphs and the strokes they are mistaken for.
STROKES = (("m", "rrl"), ("n", "rl"), ("u", "ll"), ("h", "ll"), ("d", "cl"), ("w", "vv"))
SINGLES = ("i1!|0597e2tz86", "llllosgfczfzbb")
#: The outer share of the page height where headers and footers stand; a form this many times rarer than another of its
#: skeleton, in the corpus or after the word before it, is a misreading.
ZONE, RATIO = 0.08, 5
#: Up to so many spellings are broadcast; more are joined by shuffle.
SPELLINGS = 200_000
#: Blocks no higher than this (one line of small type) stand beside the flow of the text.
SMALL_PRINT = 12.0


def skeleton(word: Column) -> Column:
    """The strokes of a lower-case word: accents dropped, glyphs that scanners confuse made equal."""
    out = F.translate(word, "áàâãåäéèêëíìîïóòôõöúùûüýñç", "aaaaaaeeeeiiiiooooouuuuync")
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return F.translate(out, *SINGLES)


def _plain(text: Column) -> Column:
    """Ligatures written out; line breaks of any kind are one."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for lig, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(lig), F.lit(letters))
    return out


def _glued(text: Column) -> Column:
    """Broken words as one token with a break sign: a mark after a letter, then a line break or blank, then a letter."""
    # patterns that begin with the mark itself are looked for at marks only
    out = F.regexp_replace(text, "[" + SOFT_MARKS + r"](?<=[\p{L}\p{N}].)\s+(?=[\p{L}\p{N}!])", _SOFT)
    return F.regexp_replace(out, r"-(?<=[\p{L}\p{N}]-)\s+(?=[\p{Ll}\p{N}!])", _HARD)


def _flat(text: Column) -> Column:
    """White space of any kind as single-character blanks, none at the ends."""
    for char in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(char), F.lit(" "))
    return F.trim(text)


def _broken(token: Column) -> Column:
    return token.contains(_HARD) | token.contains(_SOFT)


def running_blocks(blocks: DataFrame, *, page_height: float = 792.0) -> DataFrame:
    """Ids of running headers, running footers and page numbers, of ``blocks`` (id, file, page, read, y, h, raw).

    A one-line block in the outer ``ZONE`` of the page is one if its text with digits and roman numbers masked stands on
    another page of the file, or its place (top or bottom, line height) is taken on another page of the file or the same
    masked text stands in another file, or it is nothing but a page number. Titles, captions, values and footnotes lie
    further inside.
    """
    top = F.col("y") + F.col("h") <= page_height * ZONE
    low = F.col("y") >= page_height * (1 - ZONE)
    masked = F.regexp_replace(F.lower(F.trim("raw")), r"\d+|\b[ivxlc]+\b", "#")
    edge = blocks.where((top | low) & ~F.trim("raw").contains("\n")).select(
        "id", "file", "page", F.when(top, "top").otherwise("bottom").alias("side"), F.round("h", 0).alias("line"), masked.alias("mask")
    )
    per_mask = edge.groupBy("file", "mask").agg(F.count_distinct("page").alias("mask_pages"))
    per_place = edge.groupBy("file", "side", "line").agg(F.count_distinct("page").alias("place_pages"))
    files = per_mask.groupBy("mask").agg(F.count(F.lit(1)).alias("files"))
    told = edge.join(per_mask, ["file", "mask"]).join(per_place, ["file", "side", "line"]).join(files, "mask")
    number = F.col("mask").rlike(r"^[\W_]*(page|p|seite|s)?[\W_]*#([\W_]*(of|/|von|de|sur)?[\W_]*#)?[\W_]*$")
    return told.where((F.col("mask_pages") > 1) | (F.col("place_pages") > 1) | (F.col("files") > 1) | number).select("id").distinct()


def _blocks(pages: DataFrame) -> DataFrame:
    raw = _plain(F.coalesce("text", "normalized_text"))
    return pages.where("block_id is not null").select(
        F.col("block_id").alias("id"), F.col("file_path").alias("file"), F.col("page_index").alias("page"), F.col("read_at").alias("read"),
        F.col("y").alias("y"), F.col("x").alias("x"), F.col("height").alias("h"), F.coalesce(raw, F.lit("")).alias("raw"),
    ).withColumn("flat", _flat(_glued(F.col("raw"))))


def _ends(blocks: DataFrame, running: DataFrame) -> DataFrame:
    """Blocks that end in a hyphen: id, ``a`` the part of the word before it, ``mark``, and ``next``, the first word of the text that goes on
    after them, if it goes on in lower case.

    It is in the next block of the page, as it was read, that starts in lower case, or the first such block of the next page.
    Running blocks take no part.
    """
    marks = f"[{SOFT_MARKS}-]"
    part = F.when(F.rtrim("flat").rlike(marks + "$"), F.lower(F.regexp_extract("flat", r"([\p{L}\p{N}!]+)" + marks + "$", 1)))
    # words and marks go on from here, texts don't
    body = blocks.join(running, "id", "left_anti").select(
        "id", "file", "page", "read", "y", "x", F.regexp_extract("flat", r"^([\p{Ll}\p{N}!][\p{L}\p{N}!]*)", 1).alias("start"), F.nullif(part, F.lit("")).alias("a"), F.right("flat", F.lit(1)).alias("mark")
    ).where("a is not null or start != ''")
    line = Window.partitionBy("file", "page", "read").orderBy("y", "x", "id")
    here = body.withColumn("here", F.first(F.nullif("start", F.lit("")), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))).where("a is not null")
    first = body.where("start != ''").groupBy("file", (F.col("page") - 1).alias("page")).agg(F.min_by("start", F.struct("read", "y", "id")).alias("over"))
    return here.join(first, ["file", "page"], "left").select("id", "a", "mark", F.coalesce("here", "over").alias("next"))


def _pieces(blocks: DataFrame) -> DataFrame:
    """One row per piece between blanks: id, pos (rises, but not always by one), piece, ``last`` of its block, ``p`` the pieces of the block."""
    rows = blocks.select("id", F.split("flat", " ").alias("p"))
    told = rows.select("id", "p", F.posexplode("p").alias("pos", "piece")).where("piece != ''")
    return told.select("id", "pos", "piece", (F.col("pos") == F.size("p") - 1).alias("last"), "p")


def _bare(piece: Column) -> Column:
    """A piece in lower case, without marks around it, break signs kept."""
    return F.rtrim(F.ltrim(F.lower(piece), F.lit("\"'“„«([")), F.lit(".,;:!?\"'”“»)]…"))


def _cut_off(piece: Column) -> Column:
    return F.col("last") & piece.rlike(f"[-{SOFT_MARKS}]$")


def _tokens(blocks: DataFrame) -> DataFrame:
    """One row per token: id, pos, ``t`` (see ``_bare``), ``last`` of its block."""
    return _pieces(blocks).select("id", "pos", "piece", _bare(F.col("piece")).alias("t"), "last").where("t != ''")


def _forms(pieces: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Every spelling of a piece (piece, t), and every whole form with its count, skeleton, and the best form of the skeleton: form, n, sk, best, best_n.

    Pieces are counted as they stand, so all else is done once per spelling, not once per place.
    """
    spelled = stash.put(pieces.groupBy("piece", _cut_off(F.col("piece")).alias("cut")).agg(F.count(F.lit(1)).alias("n")).withColumn("t", _bare(F.col("piece"))).where("t != ''"))
    counts = spelled.where(~_broken(F.col("t")) & ~F.col("cut")).groupBy(F.col("t").alias("form")).agg(F.sum("n").alias("n")).withColumn("sk", skeleton(F.col("form")))
    counts = stash.put(counts)
    best = counts.groupBy("sk").agg(F.max(F.struct("n", "form")).alias("b")).select("sk", F.col("b.form").alias("best"), F.col("b.n").alias("best_n"))
    return spelled, stash.put(counts.join(best, "sk"))


def _by_context(seen: DataFrame, pieces: DataFrame, spelled: DataFrame, stash: Stash) -> DataFrame:
    """Ids of blocks with a form that the word before it tells to be a misreading: after that word the best form of its skeleton stands ``RATIO`` times as often or more.

    ``seen``: id, form, best, before. For forms that are too frequent of their own to be told by their number.
    """
    asked = stash.put(seen.where("before != ''").groupBy("before", "form", "best").agg(F.count(F.lit(1)).alias("own")))
    wanted = stash.put(spelled.join(asked.select(F.col("best").alias("t")).distinct(), "t", "left_semi").select("piece", "t").distinct())
    there = pieces.join(broadcast_if(wanted, SPELLINGS), "piece").select(F.col("t").alias("best"), _bare(F.coalesce(F.get("p", F.col("pos") - 1), F.lit(""))).alias("before"))
    after = there.groupBy("before", "best").agg(F.count(F.lit(1)).alias("after"))
    told = asked.join(after, ["before", "best"]).where(F.col("after") >= RATIO * F.col("own")).select("before", "form")
    return seen.join(told, ["before", "form"], "left_semi").select("id")


def page_noise(pages: DataFrame) -> DataFrame:
    """(``block_id``, ``noise``), one row per block and kind: ``running``, ``hyphen``, ``misread``.

    ``pages`` has the columns of page_blocks. The text of a block is ``text``, or ``normalized_text`` where that is
    null; if both are null the block has no noise. A word broken with a soft mark is always broken; with a plain hyphen
    it is broken unless the compound is the commoner form of the corpus. A token is misread if a form of the same
    skeleton is at least ``RATIO`` times as frequent, in the corpus or, where both are common, after the word before it.
    Ligatures are no misreadings. Repeated ids count once, null ids are ignored. Counts cover all blocks.
    """
    stash = Stash(pages.sparkSession)
    blocks = stash.put(_blocks(pages))
    running = stash.put(running_blocks(blocks))
    pieces = _pieces(blocks)
    spelled, forms = _forms(pieces, stash)
    by_sk = forms.groupBy("sk").agg(F.sum("n").alias("n"))

    # the places that matter: broken words, and spellings that may be misread; all others stay where they are
    doubtful = forms.where((F.col("form") != F.col("best")) & _letters()).select(F.col("form").alias("t"), "best", F.when(_misread(), "number").otherwise("context").alias("by"))
    asked = spelled.where(~F.col("cut") & ~_broken(F.col("t"))).select("piece", "t").distinct().join(doubtful, "t")
    asked = stash.put(asked.unionByName(spelled.where(_broken(F.col("t"))).select("piece", "t", F.lit("").alias("best"), F.lit("broken").alias("by")).distinct()))
    before = F.get("p", F.col("pos") - 1)
    places = pieces.join(broadcast_if(asked, SPELLINGS), "piece").where((F.col("by") == "broken") | ~_cut_off(F.col("piece")))
    places = stash.put(places.select("id", "pos", "t", "best", "by", _bare(F.coalesce(before, F.lit(""))).alias("before")))

    # words broken within a block
    inner = places.where("by = 'broken'").select(
        "id", "pos", "t", F.regexp_replace("t", f"[{_HARD}{_SOFT}]", "").alias("joined"), F.regexp_replace("t", f"[{_HARD}{_SOFT}]", "-").alias("kept"), F.col("t").contains(_SOFT).alias("soft")
    )
    # words broken at the end of a block
    ends = _ends(blocks, running)
    ends = ends.select(
        "id", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("t"), F.concat("a", F.lower(F.coalesce("next", F.lit("")))).alias("joined"),
        F.concat("a", F.lit("-"), F.lower(F.coalesce("next", F.lit("")))).alias("kept"), (F.col("mark") != "-").alias("soft"),
    )
    broken = stash.put(_judged(inner.unionByName(ends), by_sk))
    hyphen = broken.where("broken").select("id").distinct()

    # misread: of whole tokens, and of broken ones as they read when joined; a cut word at the edge of a block can't be judged
    continued = blocks.where(F.col("flat").rlike(r"^\p{Ll}")).select("id", F.lit(0).alias("pos"))
    whole = places.where("by != 'broken'").join(continued, ["id", "pos"], "left_anti")
    first = whole.where("by = 'number'").select("id")
    ambiguous = stash.put(whole.where("by = 'context'").select("id", F.col("t").alias("form"), "best", "before"))
    third = _by_context(ambiguous, pieces, spelled, stash)
    mended = broken.where("pos >= 0").select("id", F.when(F.col("broken"), F.col("joined")).otherwise(F.col("kept")).alias("form")).withColumn("sk", skeleton(F.col("form")))
    right = forms.where("form = best").select("sk", "best", "best_n")
    own = forms.select(F.col("form").alias("f"), "n")
    told = mended.join(right, "sk").join(own, mended["form"] == own["f"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    second = told.where((F.col("form") != F.col("best")) & _misread()).select("id")
    misread = first.unionByName(second).unionByName(third).distinct()
    kinds = [(running, "running"), (hyphen, "hyphen"), (misread, "misread")]
    out = None
    for df, kind in kinds:
        part = df.select(F.col("id").alias("block_id"), F.lit(kind).alias("noise"))
        out = part if out is None else out.unionByName(part)
    return out


def _letters() -> Column:
    return F.col("form").rlike(r"\p{L}") & ((F.length("form") > 1) | F.col("form").rlike(r"[^\x00-\x7F]"))


def _misread() -> Column:
    return _letters() & (F.col("best_n") >= RATIO * F.greatest("n", F.lit(1)))


def _judged(words: DataFrame, by_sk: DataFrame) -> DataFrame:
    """``broken``: soft marks always; a hard hyphen unless the compound, misread or not, is the commoner form."""
    one = by_sk.select(F.col("sk").alias("sk_j"), F.col("n").alias("n_j"))
    two = by_sk.select(F.col("sk").alias("sk_k"), F.col("n").alias("n_k"))
    told = words.withColumn("sk_j", skeleton(F.col("joined"))).withColumn("sk_k", skeleton(F.col("kept"))).join(one, "sk_j", "left").join(two, "sk_k", "left")
    return told.select("id", "pos", "t", "joined", "kept", (F.col("soft") | (F.coalesce("n_k", F.lit(0)) <= F.coalesce("n_j", F.lit(0)))).alias("broken"))


def repaired_paragraphs(pages: DataFrame) -> DataFrame:
    """Continuous paragraphs: file_path, ``small`` (small print beside the flow), ``paragraph`` (from 0, separately for both), ``text``, ``blocks`` (how many it was made of).

    Running blocks are left out; of a page that was read several times the latest reading counts. Broken words are
    joined, misread words replaced by the best form of their skeleton: of several supported forms the one that most
    often follows the word before it, else the commonest. A block that starts in lower case continues the paragraph
    before it, across pages. Files without text have no row.
    """
    stash = Stash(pages.sparkSession)
    blocks = stash.put(_blocks(pages))
    running = stash.put(running_blocks(blocks))
    tokens = stash.put(_tokens(blocks))
    _, forms = _forms(_pieces(blocks), stash)
    by_sk = forms.groupBy("sk").agg(F.sum("n").alias("n"))
    latest = blocks.groupBy("file", "page").agg(F.max("read").alias("read"))
    kept = stash.put(blocks.join(latest, ["file", "page"]).where(blocks["read"].eqNullSafe(latest["read"])).drop(latest["read"]).join(running, "id", "left_anti"))
    words = tokens.join(kept.select("id"), "id", "left_semi")
    inner = words.where(_broken(F.col("t"))).select(
        "id", "pos", "t", F.regexp_replace("t", f"[{_HARD}{_SOFT}]", "").alias("joined"), F.regexp_replace("t", f"[{_HARD}{_SOFT}]", "-").alias("kept"), F.col("t").contains(_SOFT).alias("soft")
    )
    judged = _judged(inner, by_sk).select("id", "pos", "broken")
    told = words.join(judged, ["id", "pos"], "left").withColumn(
        "plain", F.regexp_replace("piece", f"[{_HARD}{_SOFT}]", F.lit("\ue002"))
    ).withColumn("plain", F.replace("plain", F.lit("\ue002"), F.when(F.col("broken"), F.lit("")).otherwise(F.lit("-"))))
    told = told.withColumn("form", F.regexp_replace("t", f"[{_HARD}{_SOFT}]", F.lit("\ue002"))).withColumn("form", F.replace("form", F.lit("\ue002"), F.when(F.col("broken"), F.lit("")).otherwise(F.lit("-"))))
    told = told.withColumn("before", F.lag("form").over(Window.partitionBy("id").orderBy("pos"))).withColumn("sk", skeleton(F.col("form")))
    # facts of a form by lookup, as "the" may be a twentieth of all words
    facts = stash.put(forms.select("form", "n", ((F.col("form") != F.col("best")) & _misread()).alias("bad")))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = stash.put(told)
    supported = forms.where(F.col("n") >= RATIO).select("sk", F.col("form").alias("right"), F.col("n").alias("support"))
    wrong = stash.put(lookup(told, facts, "form", "n", total, "left").where("bad or (broken is not null and n is null)").select("id", "pos", "form", "before", "sk"))
    pairs = told.where("before is not null").join(wrong.select("before").distinct(), "before", "left_semi").groupBy("before", F.col("form").alias("right")).agg(F.count(F.lit(1)).alias("after"))
    choice = wrong.join(supported, "sk").join(pairs, ["before", "right"], "left").groupBy("id", "pos").agg(F.max(F.struct(F.coalesce("after", F.lit(0)).alias("after"), F.col("support"), F.col("right"))).alias("c"))
    fixed = told.join(choice.select("id", "pos", F.col("c.right").alias("right")), ["id", "pos"], "left")
    body = F.col("right")
    cased = F.when(F.col("plain").rlike(r"^[\"'“„«(\[]*\p{Lu}{2}"), F.upper(body)).when(F.col("plain").rlike(r"^[\"'“„«(\[]*\p{Lu}"), F.concat(F.upper(F.substring(body, 1, 1)), F.expr("substring(right, 2)"))).otherwise(body)
    lead = F.regexp_extract("plain", r"^([\"'“„«(\[]*)", 1)
    tail = F.regexp_extract("plain", r"([.,;:!?\"'”“»)\]…]*)$", 1)
    fixed = fixed.withColumn("word", F.when(F.col("right").isNull(), F.col("plain")).otherwise(F.concat(lead, cased, tail)))
    lines = fixed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("line"))
    laid = kept.join(lines, "id")
    # captions, values and footnotes are small print beside the flow of the text
    laid = laid.withColumn("small", F.col("h") <= SMALL_PRINT)
    # paragraphs are numbered page by page, then by the sums of the pages, so no window goes over the blocks of a file
    page = Window.partitionBy("file", "small", "page").orderBy("y", "x", "id")
    laid = stash.put(laid.withColumn("place", F.row_number().over(page)).withColumn("lower", F.col("line").rlike(r"^\p{Ll}")))
    heads = laid.groupBy("file", "small", "page").agg(F.count_if(~F.col("lower")).alias("news"))
    pages_of = Window.partitionBy("file", "small").orderBy("page")
    heads = heads.withColumn("first", F.row_number().over(pages_of) == 1).withColumn("sofar", F.coalesce(F.sum("news").over(pages_of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opens = laid.where("place = 1 and lower").select("file", "small", "page", F.lit(1).alias("opens"))
    # the first block of a file is a paragraph even if it starts in lower case
    heads = heads.join(opens, ["file", "small", "page"], "left").withColumn("extra", F.max(F.when(F.col("first"), F.coalesce("opens", F.lit(0)))).over(Window.partitionBy("file", "small")))
    laid = laid.join(heads.select("file", "small", "page", "sofar", "extra"), ["file", "small", "page"])
    laid = laid.withColumn("paragraph", F.col("sofar") + F.col("extra") - 1 + F.sum(F.when(F.col("lower"), 0).otherwise(1)).over(page))
    joined = laid.groupBy("file", "small", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page", "y", "x", "id", "line"))).alias("ls"), F.count(F.lit(1)).alias("blocks"))
    text = F.aggregate(
        "ls", F.lit(""), lambda acc, x: F.when(acc == "", x["line"]).when(acc.rlike(f"[{SOFT_MARKS}-]$"), F.concat(F.regexp_replace(acc, f"[{SOFT_MARKS}-]$", ""), x["line"])).otherwise(F.concat(acc, F.lit(" "), x["line"]))
    )
    return joined.select(F.col("file").alias("file_path"), "small", "paragraph", text.alias("text"), "blocks")
