"""Text cut off by field limits or in transfer: word trigrams inside texts versus at ends.

All texts are brought into words (encoded bodies decoded, mark-up, quote marks and headers left
out, digits masked, a stop mark between sentences and blocks), and into forms, one a line: header
line, boundary, closing boundary, soft line break, whole or broken base64, end of mark-up, other.
Every trigram of words and of forms in the corpus is counted by what follows it: more, a stop, or the
end of the text. Then the final trigrams of each text are joined:

* cut in a sentence or part: the trigram goes on in other texts, again and again, and all but never
  stops. So a multipart text is cut if it ends in anything but what its like end in;
* cut in a word, number or code: in the same place other texts hold, again and again, a longer word
  (or form) that begins with the last one, and all but never that last one itself;
* cut in a word after a rare context: the last word, or the part of an address from its @ on, stands
  inside no text at all, but again and again begins words that do.

Texts that end where many of their source end (a field limit, in characters, bytes or characters
of the body) and whose cut is shown by the above in most of that group are cut as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligaquery import session
from ligaquery.session import byte_size, lookup, settle

#: A trigram must go on at least so often, a longer word be met so often, and the share of stops be at most so large.
#: They are the least evidence in counts, so a corpus in which the like of a text is rarer does not tell on it.
MIN_INSIDE, MIN_LONGER, MAX_STOPS = 20, 10, 0.02
#: A length is a limit of its source if so many texts of that length are shown to be cut, so large a
#: share of the texts of that length, and so large a share of the source's texts shown to be cut.
MIN_AT_LIMIT, MIN_SHARE, MIN_OF_SOURCE = 3, 0.5, 0.05
#: Beginnings of words are joined by so many characters; longer ones are compared after the join.
PREFIX = 40
STOP = "¶"
BLANKS = " \t\n\v\f\r"
#: Marks that some systems put where they cut.
MARKS = ("...", "…", "[…]", "[...]")
#: Begins every form, so that no word is one.
FORM = "\x02"


def _qp_decoded(text: Column) -> Column:
    soft = F.regexp_replace(F.regexp_replace(text, r"=\r?\n", ""), r"=[0-9A-F]?$", "")
    plain = F.regexp_replace(F.regexp_replace(soft, "%", "%25"), r"\+", "%2B")
    return F.url_decode(F.regexp_replace(plain, "=([0-9A-F]{2})", "%$1"))


def _without_mark(text: Column) -> Column:
    """``text`` without blanks and one of MARKS at its end; null if there is no mark."""
    bare = F.rtrim(text, F.lit(BLANKS))
    out = F.lit(None).cast("string")
    for m in MARKS:  # the longest that fits comes last and wins
        out = F.when(F.endswith(bare, F.lit(m)), F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - len(m)), F.lit(BLANKS))).otherwise(out)
    return out


def parts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``body`` (decoded), its ``forms``, ``closed_part`` (a multipart text with its end) and ``body_chars``."""
    t = F.col(text)
    split = F.regexp_instr(t, F.lit(r"\r?\n\r?\n"))
    has_head = t.rlike(r"^\ufeff?[A-Za-z][A-Za-z-]*: ")
    df = df.withColumn("__head", F.when(has_head, F.when(split > 0, F.substring(t, F.lit(1), split)).otherwise(t)).otherwise(""))
    df = df.withColumn("__rest", F.when(~has_head, t).when(split > 0, F.regexp_replace(F.substr(t, split), r"^\r?\n\r?\n", "")).otherwise(""))
    low = F.lower("__head")
    df = df.withColumn("__boundary", F.when(low.contains("multipart/"), F.regexp_extract("__head", r'(?i)boundary="?([^"\r\n;]+)"?', 1)).otherwise(""))
    df = df.withColumn("__cte", F.when(F.col("__boundary") == "", F.regexp_extract(low, r"content-transfer-encoding:\s*([a-z0-9-]+)", 1)).otherwise(""))
    rest = F.col("__rest")
    # some systems deliver the decoded body under the old header
    coded = (F.col("__cte") == "base64") & rest.rlike(r"^[A-Za-z0-9+/=\s]*(\.\.\.|…|\[…\]|\[\.\.\.\])?\s*$")
    kind = F.when(F.col("__boundary") != "", "m").when(coded, "b").when(F.col("__cte") == "quoted-printable", "q").when(F.lower(rest).contains("<html"), "w").otherwise("p")
    df = df.withColumn("__kind", kind)
    packed = F.regexp_replace(rest, r"\s+", "")
    whole = F.substring(packed, F.lit(1), (F.floor(F.length(packed) / 4) * 4).cast("int"))
    decoded = F.try_to_binary(whole, F.lit("base64")).cast("string")
    is_ = lambda k: F.col("__kind") == k
    body = F.when(is_("b"), F.coalesce(decoded, F.lit(""))).when(is_("q"), _qp_decoded(rest)).otherwise(rest)
    edge = F.concat(F.lit("--"), "__boundary")
    closed = is_("m") & rest.contains(F.concat(edge, F.lit("--")))
    lines = F.split(F.rtrim(rest, F.lit(BLANKS)), r"\r?\n")

    each = lambda form: F.transform(lines, lambda x: F.concat(F.lit(FORM), "__kind", form(x)))
    quanta = lambda x: F.when(x.rlike(r"[.…\]]$"), "q").otherwise(_whole(x))
    _whole = lambda x: F.substring(F.lit("qqqq"), F.lit(1), F.coalesce(F.nullif(F.length(x) % 4, F.lit(0)), F.lit(4)))
    escape = lambda x: F.when(F.endswith(x, F.lit("=")), "=").when(F.substring(x, -2, 1) == "=", "=h").when(F.substring(x, -3, 1) == "=", "=hh").otherwise("t")
    border = lambda x: F.when(~F.startswith(x, edge), "t").when(F.startswith(x, F.concat(edge, F.lit("--"))), "/").otherwise("-")
    end = lambda x: F.when(F.lower(x).contains("</html>"), "/").otherwise("t")
    inside = F.when(is_("m"), each(border)).when(is_("b"), each(quanta)).when(is_("q"), each(escape)).when(is_("w"), each(end)).otherwise(F.array(F.lit(f"{FORM}p")))
    # any line of other text or whole quanta may be the last of a text of their kind, which tells nothing: it ends as a plain text does
    df = df.withColumn("__inside", inside)  # used twice, computed once
    inside = F.concat("__inside", F.when(F.element_at("__inside", -1).isin(f"{FORM}bqqqq", f"{FORM}qt"), F.array(F.lit(f"{FORM}p"))).otherwise(F.array()))
    n_head = F.size(F.split(F.rtrim(F.col("__head"), F.lit(BLANKS)), "\n"))
    forms = F.concat(F.when(has_head, F.array_repeat(F.lit(f"{FORM}:"), n_head)).otherwise(F.array()), F.when(has_head & (split == 0), F.array()).otherwise(inside))
    return df.withColumns({"body": body, "forms": F.when(t.isNotNull(), forms), "closed_part": F.coalesce(closed, F.lit(False)), "body_chars": F.length(rest)}).drop("__head", "__rest", "__boundary", "__cte", "__kind", "__inside")


def words(body: Column) -> Column:
    """The words of a body; a pair of stop marks stands between sentences and after short lines."""
    t = F.replace(body, F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, r"\n[>\s]*[>\s]", "\n")  # quote marks and empty lines
    t = F.regexp_replace(t, r"<[^>\n]*>|\n[A-Za-z0-9+/]{60,}={0,2}(?=\n)", " ")  # tags and encoded lines
    t = F.regexp_replace(t, '[,;:()"]+', "")
    t = F.regexp_replace(t, r"\n(?<=[^\n]{45}\n)", " ")
    t = F.regexp_replace(t, r"[\n。！？]|[.?!]+(?=\s|$)", f" {STOP} {STOP} ")
    beyond = body.rlike("[^\\x{0}-\\x{2e7f}]")  # cheap, and true of any text with Han characters
    t = F.when(beyond, F.regexp_replace(t, r"(\p{IsHan})", " $1 ")).otherwise(t)
    t = F.regexp_replace(t, "[1-9]", "0")
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def _final(toks: Column, name: str) -> list[Column]:
    """The final trigram; stop marks at the very end are left out, missing words are stop marks."""
    last = F.size(toks) - F.when(F.get(toks, F.size(toks) - 1) == STOP, 3).otherwise(1)
    return [F.coalesce(F.when(last >= 2 - k, F.get(toks, last - 2 + k)), F.lit(STOP)).alias(f"{name}{k}") for k in range(3)]


def _from_at(word: Column) -> Column:
    return F.substr(word, F.instr(word, "@"))


def _begins(word: str) -> Column:
    """The beginnings of a word of up to PREFIX characters."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(word), F.lit(PREFIX))), lambda k: F.substr(word, F.lit(1), k)))


def never_words(rows: DataFrame) -> DataFrame:
    """(n_): final words of unended texts that stand inside no text, but begin words that do; of an address also the part from the @ on.

    Words count once a text. Unended final words don't count as words, as they may be cut themselves.
    """
    inner = F.slice("toks", F.lit(1), F.size("toks") - F.when(F.col("open_word").isNull(), 0).otherwise(1))
    known = rows.where("size(toks) > 0").select(F.explode(F.array_distinct(inner)).alias("w")).where(F.col("w") != STOP).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    known = known.select(F.explode(F.when(F.col("w").contains("@"), F.array("w", _from_at(F.col("w")))).otherwise(F.array("w"))).alias("w"), "n")
    last = rows.where("open_word IS NOT NULL AND NOT closed_part").select(F.col("open_word").alias("n_")).distinct()
    unit = last.select("n_", F.explode(F.when(F.col("n_").contains("@"), F.array("n_", _from_at(F.col("n_")))).otherwise(F.array("n_"))).alias("c")).where("c <> '@'")
    unit = settle(unit)
    units = unit.select("c").distinct().withColumn("key", F.substring("c", F.lit(1), F.lit(PREFIX)))
    met = lookup(known.select("w", "n", _begins("w").alias("k")), units, (F.col("k") == F.col("key")) & F.startswith("w", "c"))
    own = F.col("w") == F.col("c")
    facts = met.groupBy("c").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("longer"))
    return unit.join(facts.where((F.col("own") == 0) & (F.col("longer") >= MIN_LONGER)), "c").select("n_").distinct()


def cut_trigrams(rows: DataFrame, finals: DataFrame) -> DataFrame:
    """(f0, f1, f2, in_part, in_word): what the corpus tells on each final trigram (f0, f1, f2).

    ``rows`` hold the sequences (p): two stop marks, the words or forms, then a stop mark if the text is
    ended, else an empty word. If the pairs that finals begin with are few enough to be broadcast, other
    trigrams are left out before counting; else all are counted, so that equal ones meet as counts only.
    """
    pairs = finals.select(F.col("f0").alias("a_"), F.col("f1").alias("b_")).distinct()
    few = byte_size(pairs) <= session.BROADCAST_BYTES
    at = lambda k: F.get("p", F.col("i") + k)
    grams = rows.select("p", F.explode(F.sequence(F.lit(2), F.size("p") - 2)).alias("i")).select(at(-2).alias("a"), at(-1).alias("b"), at(0).alias("w"), at(1).alias("nxt")).where(F.col("w") != STOP)
    same = (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))
    grams = grams.join(F.broadcast(pairs), same, "left_semi") if few else grams
    counts = grams.groupBy("a", "b", "w").agg(F.count_if(~F.col("nxt").isin(STOP, "")).alias("inside"), F.count_if(F.col("nxt") == STOP).alias("stops"), F.count_if(F.col("nxt") == "").alias("ends"))
    counts = counts if few else lookup(counts, pairs, same, "left_semi")
    keyed = counts.select("*", _begins("w").alias("c"))
    met = lookup(keyed, finals.withColumn("key", F.substring("f2", F.lit(1), F.lit(PREFIX))), (F.col("a") == F.col("f0")) & (F.col("b") == F.col("f1")) & (F.col("c") == F.col("key")) & F.startswith("w", "f2"))
    own = F.col("w") == F.col("f2")
    facts = met.groupBy("f0", "f1", "f2").agg(
        *(F.sum(F.when(own, F.col(x)).otherwise(0)).alias(x) for x in ("inside", "stops", "ends")),
        F.sum(F.when(~own, F.col("inside") + F.col("stops")).otherwise(0)).alias("longer"),
    )
    others = F.greatest(F.col("stops") + F.col("ends") - 1, F.lit(0))  # without this text's own end
    in_part = (F.col("inside") >= MIN_INSIDE) & (others <= MAX_STOPS * F.col("inside"))
    in_word = (F.col("longer") >= MIN_LONGER) & (F.col("inside") + others <= MAX_STOPS * F.col("longer"))
    return facts.select("f0", "f1", "f2", (in_part | in_word).alias("told")).where("told")


def evidence(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """(id, src, by) for each row: what shows that its text breaks off.

    ``by`` is the first of words, forms (final trigrams of either), rare (a final word after a rare
    context) and limit (the length), or null. Null, empty and blank texts do not break off; a null source
    is a source; repeated rows count each on its own; an empty table gives an empty result. Whole texts are read.
    """
    t = F.col(text)
    alive = F.coalesce(t.rlike(r"\S"), F.lit(False))
    rows = parts(df.select(F.col(row_id).alias("id"), F.col(source).alias("src"), F.when(alive, t).alias("t")), "t")
    bare = F.rtrim("body", F.lit(BLANKS))
    rows = rows.withColumns({"unmarked": _without_mark(F.col("body")), "bare": bare})
    toks = words(F.rtrim(F.coalesce("unmarked", "body"), F.lit("\ufffd")))
    new_line = F.substr("body", F.length("bare") + 1).contains("\n")
    ended = F.coalesce((F.right("bare", F.lit(1)).isin(*".?!。！？") | new_line) & F.col("unmarked").isNull(), F.lit(False))
    none = F.array().cast("array<string>")
    rows = rows.select("id", "src", F.length("t").alias("n_chars"), F.octet_length("t").alias("n_bytes"), "body_chars", "closed_part", ended.alias("ended"), F.coalesce(toks, none).alias("toks"), F.coalesce("forms", none).alias("forms"))
    last = F.get("toks", F.size("toks") - 1)
    rows = settle(rows.select("*", F.when(~F.col("ended") & (last != STOP), last).alias("open_word"), *_final(F.col("toks"), "f"), *_final(F.col("forms"), "g")))

    finals = rows.where("NOT closed_part").select(F.inline(F.array(*(F.struct(*(F.col(f"{x}{k}").alias(f"f{k}") for k in range(3)), F.size(n).alias("n")) for x, n in (("f", "toks"), ("g", "forms"))))))
    finals = settle(finals.where("n > 0").select("f0", "f1", "f2").distinct())
    begin, stop = F.array(F.lit(STOP), F.lit(STOP)), lambda c: F.when(c, F.array(F.lit(STOP))).otherwise(F.array(F.lit("")))
    padded = F.array(F.concat(begin, "toks", stop(F.col("ended"))), F.concat(begin, "forms", stop(F.lit(False))))
    told = settle(cut_trigrams(rows.select(F.explode(padded).alias("p")).where("size(p) > 3"), finals))
    slim = rows.drop("toks", "forms")
    for x in "fg":
        names = {k: f"{x}_{k}" for k in ("f0", "f1", "f2", "told")}
        own = told.select(*(F.col(k).alias(v) for k, v in names.items()))
        slim = lookup(slim, own, (F.col(f"{x}0") == F.col(names["f0"])) & (F.col(f"{x}1") == F.col(names["f1"])) & (F.col(f"{x}2") == F.col(names["f2"])), "left")
    joined = lookup(slim, settle(never_words(rows)), F.col("open_word") == F.col("n_"), "left")
    by = F.when(~F.col("closed_part"), F.when(F.col("f_told"), "words").when(F.col("g_told"), "forms").when(F.col("n_").isNotNull(), "rare"))
    rows = settle(joined.select("id", "src", "n_chars", "n_bytes", "body_chars", "closed_part", "ended", by.alias("by")))

    shown = F.col("by").isNotNull()
    sizes = F.array(*(F.struct(F.lit(m).alias("unit"), F.col(m).cast("bigint").alias("size")) for m in ("n_chars", "n_bytes", "body_chars")))
    by_size = rows.where("n_chars IS NOT NULL").select("id", "src", "by", "closed_part", "ended", F.inline(sizes))
    limits = by_size.groupBy("src", "unit", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if(shown).alias("k"))
    of_source = rows.groupBy(F.col("src").alias("o_")).agg(F.count_if(shown).alias("all"))
    limits = lookup(limits.where((F.col("k") >= MIN_AT_LIMIT) & (F.col("k") >= MIN_SHARE * F.col("n"))), of_source, F.col("src").eqNullSafe(F.col("o_")))
    limits = settle(limits.where(F.col("k") >= MIN_OF_SOURCE * F.col("all")).select(F.col("src").alias("s_"), F.col("unit").alias("u_"), F.col("size").alias("z_")))
    same = F.col("src").eqNullSafe(F.col("s_")) & (F.col("unit") == F.col("u_")) & (F.col("size") == F.col("z_"))
    at_limit = lookup(by_size.where(~shown & F.expr("NOT closed_part AND NOT ended")), limits, same, "left_semi").select(F.col("id").alias("i_")).distinct()
    out = rows.join(at_limit, F.col("id").eqNullSafe(F.col("i_")), "left")
    return out.select("id", "src", F.when(~F.coalesce(shown, F.lit(False)) & F.col("i_").isNotNull(), "limit").otherwise(F.col("by")).alias("by"))


def judged(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """(row_id, source, is_cut) for each row, by ``evidence``."""
    return evidence(df, row_id, text, source).select(F.col("id").alias(row_id), F.col("src").alias(source), F.col("by").isNotNull().alias("is_cut"))


def truncated(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """(row_id) of the rows whose text breaks off; null, empty and blank texts never do."""
    return judged(df, row_id, text, source).where("is_cut").select(row_id)


def by_source(df: DataFrame, row_id: str, text: str, source: str) -> DataFrame:
    """(source, n_texts, n_cut, cut_share): how often each source truncates; n_texts counts all its rows."""
    found = judged(df, row_id, text, source).groupBy(source).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    return found.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
