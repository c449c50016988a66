"""One pass over citing works: references that are a target, sentences that point to it, name its author or hold its value.

The targets of a work, its references and its sentences are brought together once, by work and in reading order. In front of each
work's text stand its targets, from which one automaton is built for all that is looked for literally (title starts, DOIs, author
names, the letters of worded terms) and one table for numbers. The text then streams past; a task holds one work's targets and two
sentences. What comes out are candidate rows with their text and neighbours, so that patterns and quantities are tested in place and
no operator has to go back to the sentences. Bounded names: a work's targets are at most its reference list."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantity as q

PAIR = ["work_id", "target_id"]
TITLE_START = 35
TARGET, REFERENCE, SENTENCE, ROW = range(4)
# letters whose other case is ASCII: patterns ignore case
_FOLD = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})


def fold(s: str) -> str:
    return s.translate(_FOLD).lower()


def literal(words: str) -> str:
    """The longest run of ASCII letters and digits of a worded term: it stands in every text that the term's pattern matches."""
    run = "".join(c if c.isascii() and c.isalnum() else " " for c in fold(words)).split()
    return max(run, key=len, default="")


class _Targets:
    """What is looked for in one work."""

    def __init__(self):
        self.ids, self.authors, self.titles, self.matched = [], [], [], set()
        self.known, self.numbers, self.always, self.refs = set(), {}, [], {}
        self.in_refs = self.in_text = None

    def add(self, r: dict) -> None:
        if r["target_id"] in self.known:  # a pair given twice
            return
        k = len(self.ids)
        self.known.add(r["target_id"])
        self.ids.append(r["target_id"])
        self.authors.append(r["author"] or "")
        self.titles.append((r["title"] or "", r["author_low"] or ""))
        for n in r["numbers"] or ():
            self.numbers.setdefault(n, []).append(k)
        import ahocorasick
        self.in_refs = self.in_refs or ahocorasick.Automaton()
        self.in_text = self.in_text or ahocorasick.Automaton()
        for d in r["dois"] or ():
            self._put(self.in_refs, d, (k, ""))
        if r["title"]:
            self._put(self.in_refs, r["title"], (k, r["author_low"]))
        if r["author"]:
            self._put(self.in_text, fold(r["author"]), (k, True))
        for w in r["words"] or ():
            if key := literal(w):
                self._put(self.in_text, key, (k, False))
            else:
                self.always.append(k)

    @staticmethod
    def _put(automaton, key: str, value: tuple) -> None:
        automaton.add_word(key, [*automaton.get(key, []), value])

    def ready(self) -> None:
        for a in (self.in_refs, self.in_text):
            if a is not None and len(a):
                a.make_automaton()

    def reference(self, ref_id, hay: str) -> list[int]:
        """The targets that a reference is: it holds a DOI, or the start of the title and the author."""
        found = {k for _, hits in self.in_refs.iter(hay) for k, author in hits if author in hay} if len(self.in_refs) else set()
        if found:
            self.matched |= found
            self.refs.setdefault(ref_id, set()).update(found)
        return sorted(found)

    def sentence(self, text: str, numbers: list, ref_ids: list) -> dict[int, list]:
        """By target: (may hold a value, points to it, may name its author)."""
        out: dict[int, list] = {}
        at = lambda k: out.setdefault(k, [False, False, False])
        for n in numbers or ():
            for k in self.numbers.get(n, ()):
                at(k)[0] = True
        for k in self.always:
            at(k)[0] = True
        for _, hits in self.in_text.iter(fold(text)) if len(self.in_text) else ():
            for k, author in hits:
                if not author:
                    at(k)[0] = True
                elif k not in self.matched and self.authors[k] in text:
                    at(k)[2] = True
        for r in ref_ids or ():
            for k in self.refs.get(r, ()):
                at(k)[1] = True
        return out


def looked_for(ruled: DataFrame) -> DataFrame:
    """By target: numbers, worded terms, author, title start and DOIs that are looked for literally."""
    col = lambda c: F.col(c) if c in ruled.columns else F.lit(None).cast("string")
    author = F.nullif(col("first_author"), F.lit(""))
    title = F.when(author.isNotNull() & (col("title_fragment") != ""), F.substring(F.lower(col("title_fragment")), 1, TITLE_START))
    pick = lambda c: F.array_distinct(F.filter(F.transform("rules", lambda r: r[c]), lambda x: x.isNotNull()))
    dois = F.filter(F.array(F.lower(col("preprint_doi")), F.lower(col("published_doi"))), lambda d: d.isNotNull() & (d != ""))
    return ruled.select("target_id", pick("number").alias("numbers"), pick("words").alias("words"), author.alias("author"), F.lower(author).alias("author_low"),
                        title.alias("title"), dois.alias("dois"))


def scan_works(pairs: DataFrame, ruled: DataFrame, sents: DataFrame | None = None, refs: DataFrame | None = None, rows: DataFrame | None = None,
               values_only: bool = False) -> DataFrame:
    """pairs(work_id, target_id), ruled: output of with_rules, sents(work_id, pos, sentence, ref_ids, context), refs(work_id, ref_id,
    ref_text), rows(work_id, pos, sentence, context) -> one row for each of
    * step 1: a reference (ref_id) that is the target;
    * step 2: a sentence with value (a term in any spelling), holds (the old value as the target's quantity), pointer (to a matched
      reference), named (the author's name, in works without a matched reference), sentence, with_neighbours where it points or names,
      attributed (it points, and a term stands in the neighbourhood);
    * step 3: a table row with value and holds.
    With values_only, sentences are looked at for terms only: no pointers, names and neighbours. A term of numbers, and a worded one with a
    digit, stands in sentences with a digit only, so the others are not shuffled where all terms are such.
    ref_ids and context are optional. A pair given twice counts once; null sentences hold nothing; works without targets give no rows."""
    of = lambda df, c, kind: df[c] if df is not None and c in df.columns else F.lit(None).cast(kind)
    sought = looked_for(ruled)
    if values_only:
        sought = sought.withColumns({c: F.lit(None).cast("string") for c in ("author", "author_low", "title")}).withColumn("dois", F.array().cast("array<string>"))
        if sents is not None and sought.filter(F.exists("words", lambda w: ~w.rlike("[0-9]"))).isEmpty():
            sents = sents.filter(F.col("sentence").rlike(r"(?U)\d"))
    targets = pairs.select(*PAIR).join(sought, "target_id").withColumn("step", F.lit(TARGET))
    parts = [targets]
    if refs is not None:
        parts.append(refs.select("work_id", F.lit(REFERENCE).alias("step"), F.col("ref_id").cast("string").alias("ref_id"), F.lower("ref_text").alias("text")))
    for step, df in ((SENTENCE, sents), (ROW, rows)):
        if df is not None:
            parts.append(df.select(
                "work_id", F.lit(step).alias("step"), F.col("pos").cast("long").alias("pos"), F.col("sentence").alias("text"), of(df, "context", "string").alias("context"),
                (of(df, "ref_ids", "array<string>") if step == SENTENCE else F.lit(None).cast("array<string>")).alias("ref_ids"),
                F.when(F.col("sentence").rlike(r"(?U)\d"), q.posting_numbers(F.col("sentence"))).alias("numbers")))
    stream = parts[0]
    for p in parts[1:]:
        stream = stream.unionByName(p, allowMissingColumns=True)
    for c, kind in (("pos", "long"), ("text", "string"), ("context", "string"), ("ref_id", "string"), ("ref_ids", "array<string>")):
        if c not in stream.columns:
            stream = stream.withColumn(c, F.lit(None).cast(kind))
    stream = stream.repartition("work_id").sortWithinPartitions("work_id", "step", "pos")
    types = {f.name: f.dataType for f in stream.schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in PAIR] + T.DataType.fromDDL(
        "step int, pos long, ref_id string, sentence string, context string, with_neighbours string, may_hold boolean, pointer boolean, named boolean").fields)
    found = stream.mapInArrow(_passing(schema), schema)
    rules = ruled.select("target_id", "rules", "wanted", "prop", (F.col("first_author") if "first_author" in ruled.columns else F.lit("")).alias("author"))
    return _tested(found.join(rules, "target_id"))


def _passing(schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, targets, built = None, _Targets(), False
        held: list = []  # rows of the last sentence, which wait for the next one
        last, before = None, None  # (pos, text) of the last sentence and of the one before
        out: list[tuple] = []
        kinds = None

        def release(after: tuple | None) -> None:
            nonlocal held
            if held:
                near = [s for pos, s in filter(None, (before, last, after)) if s is not None and abs(pos - last[0]) <= 1]
                out.extend((*r[:7], " ".join(near) if r[8] or r[9] else None, *r[7:]) for r in held)
                held = []

        for b in batches:
            kinds = kinds or [b.schema.field(c).type for c in PAIR]
            cols = {c: b.column(c).to_pylist() for c in ("work_id", "step", "target_id", "pos", "text", "context", "ref_id", "ref_ids", "numbers")}
            for at in range(b.num_rows):
                step, text = cols["step"][at], cols["text"][at]
                if cols["work_id"][at] != work or (step == TARGET and built):
                    release(None)
                    work, targets, built, last, before = cols["work_id"][at], _Targets(), False, None, None
                if step == TARGET:
                    targets.add({c: b.column(c)[at].as_py() for c in ("target_id", "numbers", "words", "author", "author_low", "title", "dois")})
                    continue
                if not targets.ids:
                    continue
                if not built:
                    targets.ready()
                    built = True
                if step == REFERENCE:
                    for k in targets.reference(cols["ref_id"][at], text or ""):
                        out.append((work, targets.ids[k], step, None, cols["ref_id"][at], None, None, None, False, False, False))
                    continue
                if step == SENTENCE:
                    here = (cols["pos"][at], text)
                    release(here)
                    before, last = last, here
                else:
                    release(None)
                if text is not None:
                    found = targets.sentence(text, cols["numbers"][at], cols["ref_ids"][at])
                    held = [(work, targets.ids[k], step, cols["pos"][at], None, text, cols["context"][at], *what) for k, what in found.items()
                            if step == SENTENCE or what[0]]
            if len(out) >= 1000:
                yield _rows(out, kinds, names)
                out = []
        release(None)
        if kinds:
            yield _rows(out, kinds, names)

    return run


def _rows(out: list, kinds: list, names: list) -> pa.RecordBatch:
    all_kinds = [*kinds, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(all_kinds)], names)


def _tested(found: DataFrame) -> DataFrame:
    """The candidates with their patterns and quantities tested on the text that they carry."""
    any_term = lambda text: F.exists("rules", lambda r: F.coalesce(F.regexp_like(text, r["pattern"]), F.lit(False)))
    named = F.col("named") & F.regexp_like("sentence", F.concat(F.lit(r"(?U)\b\Q"), F.col("author"), F.lit(r"\E\b")))
    row_of_table = F.col("step") == ROW
    valued = found.withColumn("value", F.when(F.col("may_hold"), any_term(F.col("sentence"))).otherwise(F.lit(False))).withColumn(
        "named", F.when(row_of_table, F.lit(False)).otherwise(named)).where(
        "step = 1 OR value OR pointer OR named")
    holds: Column = q.holds_quantity(F.col("sentence"), F.col("context"), F.col("rules"), F.col("wanted"), F.col("prop"))
    return valued.select(
        *PAIR, "step", "pos", "ref_id", "sentence", "context", "with_neighbours", "pointer", "named", "value",
        F.when(F.col("value"), holds).otherwise(F.lit(False)).alias("holds"),
        F.when(F.col("pointer"), any_term(F.col("with_neighbours"))).otherwise(F.lit(False)).alias("attributed"))
