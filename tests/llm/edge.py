"""A small table with what operators must stand: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, key string, row string, digest string, word string, "
          "line string, position int, regs string, _id long, passes_whole long, kept boolean")
PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank and count "
         "every falling leaf until the evening light has gone and the cold wind starts to sing among the empty branches of the wood again "
         "so nobody hears the small grey mouse that runs along the fence toward the barn door")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def words(text):
    return WORD.findall(text or "")


def texts():
    w = PROSE.split()
    long_ = " ".join(f"{w[i % len(w)]}{i % 97}" for i in range(30000))
    return [
        (1, PROSE), (2, PROSE.upper()), (3, PROSE), (4, " ".join(w[:40] + ["changed"] + w[41:])), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one"),
        (9, "one two three four"), (10, "ONE TWO three four"), (11, "one two three four five"), (12, long_), (13, "x" * 50000), (14, "a a a a a a a a " * 40),
        (15, "b " + "a a a a a a a a " * 40), (16, "é ñ 漢字 かな 😀 ﻿    z"), (17, "Some line that is long enough to count.\nSecond line, also long enough."),
        (18, "Some line that is long enough to cout.\n\nSecond line, also long enough.\nshort"), (19, "short\nshort\n short "), (None, PROSE), (None, None),
        (20, "intro words here " + PROSE), (21, PROSE + " and some other words at the end"), (22, "Released under the MIT License.\n" + PROSE[:60]), (23, long_ + " tail"),
        (24, "<|endoftext|> x<|endoftext|>"), (25, "'S it's  we'LL   12 345 !!?"), (3, PROSE), (8, "one")]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    out = []
    for i, (d, t) in enumerate(rows):
        source = None if i % 5 == 0 else f"s{i % 3}"
        out.append((d, t, None if i % 2 else "en", source, None if t is None else len(t), i, "k", None, "d", "w", "l", i, "r", None, None, None))
    return spark.createDataFrame(out, SCHEMA)
