"""Domain terms from texts, prompts from terms, and recorded corrections of recognised text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.functions import text as T
from scribeframe.operators.validate import CREDENTIALS

#: at most so many terms, and characters of a prompt
MOST_TERMS, PROMPT_CHARS = 50, 600
#: characters of the shortest credential that has no equals sign
SECRET_CHARS = 19
# The shortest plain word and the shortest name that are terms; what ends a sentence or a line before a token.
PLAIN, NAME, SENTENCE_END = 7, 4, ".!?:;。！？\t\"'(‘“"
# Words that are never terms by themselves, as far as they stand here; ``common`` takes another list.
COMMON = tuple(
    """
about above across after again against along already also although always among another answer around because become
been before behind being below best better between beyond both bring call came case change come comes compare compared
could data days different does doing done down during each early effect either else even every example first five follow
following from further general give given good great group half have help here high however important include included
including increase instead into itself just keep know large last later least left less level like little long made main
make many maybe mean meeting might more most much must need never next none note nothing often only open other others
over part people perhaps point possible problem question quite rather really report result right same second section
see seen several should show shown since small some something still such sure than thank that their them then there
therefore these they thing think third this those three through time times today together topic total toward towards
under until upon used using very view want welcome well were what when where whether which while whole will with within
without work would year years
""".split()
)
ALNUM, GAP = r"[a-zA-Z0-9\p{L}\p{N}]", r"[^a-zA-Z0-9\p{L}\p{N}]*+"
FORM = rf"{ALNUM}++(?:[_'’-]++{ALNUM}++)*+"
#: a token of small letters, shorter than any term; what stands before a longer token or one with other characters, and that
BRIEF = rf"[a-zß-öø-ÿ]{{1,{PLAIN - 1}}}+(?!{ALNUM}|[_'’-]++{ALNUM})"
TOKEN = rf"\G((?:{GAP}{BRIEF})*+{GAP})({FORM})"
LATIN, UNSPACED_SCRIPT = r"[A-Za-zÀ-ɏſK]", r"[぀-鿿]"
#: katakana words and kanji compounds: kind of a token, its run, its class
RUNS = ((1, r"[ァ-ヺー]{3,}", 0), (2, r"[一-鿿々]{4,}", 1))


def tokens(texts: DataFrame, japanese: bool = False) -> DataFrame:
    """(doc, form, kind, spot, initial): tokens of texts with their place, and whether a capital is what any word gets there:
    at the start of a sentence, or with no letter before it on its line. Words of up to six small letters, which are never
    terms, are left out. ``kind`` is 0, with ``japanese`` also 1 for runs of katakana and 2 for runs of kanji, which come
    after the text's other tokens. A column ``part`` orders the texts of a document and stays."""
    keys = ["doc", *(["part"] if "part" in texts.columns else [])]
    own = texts.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    line = own.select(*keys, F.posexplode(F.split("text", r"[\n\r]")).alias("line", "x"))
    found = line.select(*keys, "line", F.regexp_extract_all("x", F.lit(TOKEN), F.lit(1)).alias("before"), F.regexp_extract_all("x", F.lit(TOKEN), F.lit(2)).alias("form"))
    letter = lambda x: x.rlike(r"\p{L}")
    # the line's first token that has a letter or comes after one; it goes along with every token, since as a column
    # beside them it would be looked for again at each of them
    lettered = F.when(letter(F.get("form", F.lit(0))), 1).otherwise(F.array_position(F.transform(F.arrays_zip("before", "form"), lambda t: letter(t["form"]) | letter(t["before"])), True))
    flat = found.select(*keys, "line", F.posexplode(F.arrays_zip("before", "form", F.array_repeat(lettered, F.size("form")).alias("first"))).alias("j", "t")).select(*keys, "line", "j", "t.*")
    alone = (F.col("first") == 0) | (F.col("j") + 1 < F.col("first")) | (F.col("j") + 1 == F.col("first")) & ~letter(F.col("before"))
    last = F.substring(F.rtrim("before"), -1, 1)
    spot = lambda line, j: (F.shiftleft(line.cast("long"), 32) + j).alias("spot")
    out = flat.select(*keys, "form", F.lit(0).alias("kind"), spot(F.col("line"), F.col("j")), (alone | (last != "") & (F.instr(F.lit(SENTENCE_END), last) > 0)).alias("initial"))
    for kind, run, _ in RUNS if japanese else ():
        found = own.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("j", "form"))
        out = out.unionByName(found.select(*keys, "form", F.lit(kind).alias("kind"), spot(F.lit(0), F.col("j")), F.lit(False).alias("initial")))
    return out


def term_counts(found: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(doc, key, term, kind, n, at): candidates by folded key. Class 0: names, abbreviations, codes and katakana words; class
    1: long plain words and kanji compounds. A key's term is its commonest spelling, where a token at the start of a
    sentence counts half, the smaller of equals. A name that is also written in lower case is a plain word, and plain words
    of few letters are none. ``common`` (word): words that are no terms, folded; the fixed ones without it."""
    c, place = F.col("form"), [x for x in ("part", "kind", "spot") if x in found.columns]
    # equal tokens of a text become one row before they are looked at; few of a text's are equal, so they go to their document's
    # partition as they are, where all that follows finds its groups without dealing rows out again
    first = lambda flag: F.min(F.when(flag, F.col("spot")))
    start = F.col("initial")
    rows = found.where(F.length(c) >= 3).repartition("doc").groupBy("doc", *place[:-1], "form").agg(F.count(F.when(start, 1)).alias("n1"), F.count(F.when(~start, 1)).alias("n2"), first(start).alias("s1"), first(~start).alias("s2"))
    # small letters alone, which most forms are, need none of the looks at the others
    small = c.rlike(r"\A[a-zß-öø-ÿ]+\z")
    capitals, letters = F.length(F.regexp_replace(c, r"[^\p{Lu}]+", "")), F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    capital = (capitals == 1) & c.rlike(r"^[^\p{L}]*\p{Lu}")
    loud = (capitals > 0) & ~c.rlike(r"[\p{Ll}\p{Lt}]") & (letters >= 3)
    long = F.when(F.length(c) >= PLAIN, 1)
    other = ~(c.rlike(LATIN) & ~c.rlike(UNSPACED_SCRIPT))
    kind = lambda lone: (
        F.when(F.col("kind") > 0, F.col("kind") - 1).when(small, long).when(other, None).when((F.length(c) >= NAME) & (c.rlike(r"[\p{Nd}-]") | (capitals >= 2) | lone) | loud, 0).when(letters == F.length(c), long)
    )
    rows = rows.select("*", F.when(F.col("n1") > 0, kind(F.lit(False))).alias("k1"), F.when(F.col("n2") > 0, kind(capital)).alias("k2"))
    key = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(T.casefold(c))
    rows = rows.select("*", F.explode(F.when(F.col("k1").isNotNull() | F.col("k2").isNotNull(), F.array(key))).alias("key"))
    taken = lambda k, x: F.when(F.col(k).isNotNull(), F.col(x))
    at = F.struct(*place[:-1], F.least(taken("k1", "s1"), taken("k2", "s2")).alias("spot"))
    n1, n2 = F.coalesce(taken("k1", "n1"), F.lit(0)), F.coalesce(taken("k2", "n2"), F.lit(0))
    forms = rows.select("doc", "key", "form", F.least("k1", "k2").alias("class"), F.col("kind").alias("script"), (n1 + n2).alias("n"), (n1 + 2 * n2).alias("w"), at.alias("at"))
    forms = forms.join(F.broadcast(common.select(T.casefold(F.col("word")).alias("key")).distinct()), "key", "left_anti") if common is not None else forms.where(~F.col("key").isin(*COMMON))
    if "part" in place:
        forms = forms.groupBy("doc", "key", "form").agg(F.min("class").alias("class"), F.max("script").alias("script"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("at").alias("at"))
    low = F.max((F.col("form") == F.col("key")).cast("int"))
    best = F.min(F.struct((-F.col("w")).alias("w"), "form"))["form"]
    keys = forms.groupBy("doc", "key").agg(F.min("class").alias("class"), F.max("script").alias("script"), F.sum("n").alias("n"), F.min("at").alias("at"), low.alias("low"), best.alias("term"))
    plain = (F.col("script") == 0) & (F.col("class") == 0) & (F.col("low") == 1) & ~F.col("key").rlike(r"[\p{Nd}-]")
    out = keys.withColumn("class", F.when(plain, 1).otherwise(F.col("class"))).where((F.col("script") > 0) | (F.col("class") == 0) | (F.length("term") >= PLAIN))
    return out.select("doc", "key", "term", F.col("class").cast("long").alias("kind"), F.col("n").cast("long").alias("n"), "at")


def terms(texts: DataFrame, given: DataFrame | None = None, most: int = MOST_TERMS, japanese: bool = False, common: DataFrame | None = None) -> DataFrame:
    """The first ``most`` terms of each document (doc, rank, term): given ones (doc, n, term) in their order, then those of the
    texts by class, count, length and place. A given term stands once; of the texts none is taken that is a word of a given
    one or looks like a credential."""
    secret = F.lit(False)
    for p in CREDENTIALS:
        secret = secret | F.col("term").rlike(p)
    # the shortest credential without an equals sign has 19 characters; hardly a term needs the patterns
    secret = ((F.length("term") >= SECRET_CHARS) | F.col("term").contains("=")) & secret
    counted = term_counts(tokens(texts, japanese), common).where(~secret)
    order = lambda g, n, count, length, at: F.struct(F.lit(g).alias("g"), n.cast("long").alias("class"), count.cast("long").alias("c"), length.cast("long").alias("l"), at.alias("at"))
    rows = counted.select("doc", "term", order(1, F.col("kind"), -F.col("n"), -F.length("term"), F.col("at")).alias("o"), "key")
    if given is not None:
        own = given.select("doc", "n", "term", T.casefold(F.col("term")).alias("key")).groupBy("doc", "key").agg(F.min(F.struct("n", "term")).alias("x")).select("doc", "key", "x.n", "x.term")
        every = given.select("doc", T.casefold(F.col("term")).alias("key"))
        parts = every.select("doc", F.explode(F.split("key", r"(?U)\s+")).alias("key")).union(every).distinct()
        none = F.lit(None).cast(rows.schema["o"].dataType["at"].dataType)
        zero = F.lit(0)
        rows = rows.join(parts, ["doc", "key"], "left_anti").unionByName(own.select("doc", "term", order(0, F.col("n"), zero, zero, none).alias("o"), "key"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("o", "key"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("doc", "rank", "term")


def prompts(ranked: DataFrame, most: int = PROMPT_CHARS, japanese: bool = False, given: DataFrame | None = None) -> DataFrame:
    """(doc, prompt, used): a caller's own prompt (doc, prompt), if any, then as many leading terms as fit into ``most``
    characters with it, up to the first that doesn't, as a list with a full stop. Where none fits, the caller's prompt alone."""
    comma, stop = ("、", "。") if japanese else (", ", ".")
    rows = ranked.withColumn("_given", F.lit(None).cast("string"))
    if given is not None:
        rows = ranked.join(given.select("doc", F.col("prompt").alias("_given")), "doc", "full")
    head = F.when(F.coalesce("_given", F.lit("")) != "", F.concat(F.trim("_given"), F.lit(" "))).otherwise("")
    w = Window.partitionBy("doc").orderBy("rank")
    used = F.length(head) + F.sum(F.length("term") + F.when(F.col("rank") > 1, len(comma)).otherwise(0)).over(w) + len(stop)
    row = F.array_sort(F.collect_list(F.when(F.col("_u") <= most, F.struct("rank", "term"))))
    out = rows.withColumn("_head", head).withColumn("_u", used).groupBy("doc").agg(row.alias("t"), F.max("_head").alias("h"), F.max("_given").alias("g"))
    listed = F.concat("h", F.array_join(F.transform("t", lambda x: x["term"]), comma), F.lit(stop))
    return out.select("doc", F.when(F.size("t") > 0, listed).otherwise(F.col("g")).alias("prompt"), F.size("t").cast("long").alias("used")).where("prompt is not null")


class Rules:
    """Corrections [(from, to, "word" | "substring")] as one pattern, longest ``from`` first, case ignored."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        keys = [a.casefold() for a, _, _ in rules]
        if len(set(keys)) != len(keys) or any(a == b or not a for a, b, _ in rules) or any(m not in ("word", "substring") for _, _, m in rules):
            raise ValueError("INVALID_INPUT: corrections")
        ordered = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))
        pattern = "|".join(f"(?P<r{i}>(?<!\\w){re.escape(rules[i][0])}(?!\\w))" if rules[i][2] == "word" else f"(?P<r{i}>{re.escape(rules[i][0])})" for i in ordered)
        self.pattern, self.rules = pattern, rules

    def edits(self, text: str) -> list[tuple[int, int, int, str]]:
        return [(m.start(), m.end(), int(m.lastgroup[1:]), self.rules[int(m.lastgroup[1:])][1]) for m in re.compile(self.pattern, re.IGNORECASE).finditer(text or "")]

    def apply(self, text: str) -> str:
        out, at = [], 0
        for a, b, _, to in self.edits(text):
            out += [text[at:a], to]
            at = b
        return "".join(out) + text[at:]


def corrected(segments: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """segments with ``corrected`` text and ``applied``: (rule, start, end) of every replacement in the old text."""
    plan = Rules(rules)

    @F.pandas_udf("corrected string, applied array<struct<rule: int, a: int, b: int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"corrected": [None if t is None else plan.apply(t) for t in texts], "applied": [[{"rule": r, "a": a, "b": b} for a, b, r, _ in plan.edits(t)] for t in texts]})

    return segments.withColumn("_c", run("text")).select(*segments.columns, "_c.corrected", "_c.applied")


@dataclass
class Corrected:
    """``segments`` with their new text; ``words`` with new texts and times; ``applied``: every replacement with the time of the
    words that it touches, or of the segment; ``unplaced``: segments whose words don't stand in the text and stay as they are."""

    segments: DataFrame
    words: DataFrame
    applied: DataFrame
    unplaced: DataFrame


def places(text: str, words: list[str]) -> list[tuple[int, int]] | None:
    """Where each word stands in the text, looked for from the word before on; None if one isn't there."""
    out, at = [], 0
    for x in words:
        p = -1 if x is None else text.find(x, at)
        if p < 0:
            return None
        at = p + len(x)
        out.append((p, at))
    return out


def regrouped(text: str, spots: list[tuple[int, int]], edits: list[tuple[int, int, int, str]]) -> tuple[list, list]:
    """(first, last, text) of runs of words that stay (no text) and of words that replacements make one, in order; and
    (first, last) of the words that each replacement touches, or None."""
    starts, ends = [p for p, _ in spots], [q for _, q in spots]
    touched, groups = [], []
    for a, b, _, to in edits:
        first, last = bisect_right(ends, a), bisect_left(starts, b) - 1
        touched.append((first, last) if first <= last else None)
        if first <= last and groups and first <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], last)
            groups[-1][2].append((a, b, to))
        elif first <= last:
            groups.append([first, last, [(a, b, to)]])
    runs, next_word = [], 0
    for first, last, own in groups:
        if first > next_word:
            runs.append((next_word, first - 1, None))
        at, out = starts[first], []
        for a, b, to in own:
            out += [text[at : max(a, starts[first])], to]
            at = min(b, ends[last])
        runs.append((first, last, "".join([*out, text[at : ends[last]]])))
        next_word = last + 1
    if next_word < len(spots):
        runs.append((next_word, len(spots) - 1, None))
    return runs, touched


def listed(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments (doc, seg, s, e, text) with their ``words`` (pos, text, s, e, confidence, timing) in order; words without a
    segment have a row of their own."""
    row = F.array_sort(F.collect_list(F.struct("pos", "text", "s", "e", "confidence", "timing")))
    return segments.select("doc", "seg", "s", "e", "text").join(words.groupBy("doc", "seg").agg(row.alias("words")), ["doc", "seg"], "full")


def corrected_transcripts(segments: DataFrame, words: DataFrame, rules: list[tuple[str, str, str]]) -> Corrected:
    """Corrections of segments (doc, seg, s, e, text) and of their words (doc, seg, pos, text, s, e, confidence, timing), as
    corrected_lists() has them."""
    out = corrected_lists(listed(segments, words), rules)
    return Corrected(corrected(segments, rules).withColumn("text", F.col("corrected")).drop("corrected", "applied"), out.words, out.applied, out.unplaced)


def corrected_lists(rows: DataFrame, rules: list[tuple[str, str, str]]) -> Corrected:
    """Corrections of segments with their words, as listed() gives them.

    The words that a replacement touches become one, from the first's start to the last's end, with the least confidence
    (null if any has none); replacements that share a word go together. A word made of any with an estimated time has an
    estimated time. A segment's words stay in its row until they are done, so nothing is sorted, joined or dealt out by
    word; a segment without doc or seg meets no words."""
    keys, plan = ["doc", "seg"], Rules(rules)

    @F.pandas_udf("runs array<struct<first: int, last: int, text: string>>, applied array<struct<rule: int, from: string, first: int, last: int>>, placed boolean")
    def run(texts: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, words, strict=True):
            edits = plan.edits(text)
            spots = None if text is None or own is None else places(text, list(own))
            runs, touched = (None, [None] * len(edits)) if spots is None else regrouped(text, spots, edits)
            applied = [{"rule": r, "from": text[a:b], "first": t and t[0], "last": t and t[1]} for (a, b, r, _), t in zip(edits, touched, strict=True)]
            out.append((runs and [{"first": a, "last": b, "text": x} for a, b, x in runs], applied, None if own is None else spots is not None))
        return pd.DataFrame(out, columns=["runs", "applied", "placed"], dtype=object)

    run = run.asNondeterministic()  # evaluated once, however often its columns are used
    own = F.when(F.col("doc").isNotNull() & F.col("seg").isNotNull(), F.transform("words", lambda x: x["text"]))
    found = rows.select(*keys, "s", "e", "text", "words", run("text", own).alias("c"))

    at = lambda i: F.get("words", i)
    fields = ("pos", "text", "s", "e", "confidence", "timing")

    def one(x):
        of = lambda field: F.transform(F.sequence(x["first"], x["last"]), lambda i: at(i)[field])
        conf = F.when(F.forall(of("confidence"), lambda c: c.isNotNull()), F.array_min(of("confidence")))
        timing = F.when(F.array_contains(F.array_compact(of("timing")), "interpolated"), "interpolated").otherwise(at(x["first"])["timing"])
        text = F.trim(F.regexp_replace(x["text"], r"(?U)\s+", " "))
        return F.struct(at(x["first"])["pos"].alias("pos"), text.alias("text"), at(x["first"])["s"].alias("s"), at(x["last"])["e"].alias("e"), conf.alias("confidence"), timing.alias("timing"))

    same = lambda x: F.transform(F.sequence(x["first"], x["last"]), lambda i: F.struct(*[at(i)[k].alias(k) for k in fields]))
    done = F.flatten(F.transform("c.runs", lambda x: F.when(x["text"].isNull(), same(x)).otherwise(F.array(one(x)))))
    words = found.select(*keys, F.explode(F.coalesce(done, "words")).alias("x")).select(*keys, *[F.col(f"x.{k}").alias(k) for k in fields])

    targets = F.array(*[F.lit(to) for _, to, _ in rules])
    edit = lambda x, k: F.struct(
        k.cast("long").alias("k"), x["rule"].alias("rule"), x["from"].alias("from"), F.get(targets, x["rule"]).alias("to"), F.coalesce(at(x["first"])["s"], "s").alias("s"), F.coalesce(at(x["last"])["e"], "e").alias("e"),
        F.when(at(x["first"])["s"].isNotNull(), "word").otherwise("segment").alias("timing"),
    )
    applied = found.select(*keys, F.explode(F.transform("c.applied", edit)).alias("x")).select(*keys, "x.*")
    unplaced = found.where(~F.col("c.placed") & (F.size("c.applied") > 0)).select(*keys).distinct()
    texts = corrected(rows.select(*keys, "s", "e", "text"), rules).withColumn("text", F.col("corrected")).drop("corrected", "applied")
    return Corrected(texts, words, applied, unplaced)
