"""Quantities stated in text: numbers, units, ranges, spellings and tolerant patterns, as Column expressions.

Two extractors differ on purpose. `stated_values` keeps ranges whole and makes search terms; `claim_values` makes
"number unit" keys in which both ends of a range carry the unit. They use different number and unit rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after, before, collapse, escape_regex, find_all, let, strip

# ---- Fixed values: number, range, unit and noise patterns, unit tables -------------------------------------------
NUMBER = r"\d+(?:[.,·∙⋅]\d+)?"
DECIMAL_MARK = "[.·∙⋅]"
RANGE_JOIN = r"\s*(?:-?\s*to|and|[-–—−])\s*"
RANGE_JOIN_NO_AND = r"\s*(?:-?\s*to|[-–—−])\s*"
RANGE_SPELLINGS = [" to ", "-", "–", " and "]
THOUSANDS = r"\d{1,3}(?:,\d{3})+"
UNIT_SUFFIXES = {
    "days": [" days", "-day", " d"],
    "day": [" days", "-day", " d"],
    "d": [" days", "-day", " d"],
    "weeks": [" weeks", "-week"],
    "months": [" months", "-month"],
    "years": [" years", "-year"],
    "%": ["%", " %"],
    "percent": ["%", " %", " percent"],
}
UNIT_PATTERNS = {
    "days": r"(?:days?|d)\b",
    "day": r"(?:days?|d)\b",
    "d": r"(?:days?|d)\b",
    "weeks": r"weeks?\b",
    "months": r"months?\b",
    "years": r"years?\b",
    "%": r"(?:%|per ?cent)",
    "percent": r"(?:%|per ?cent)",
}
CANONICAL_UNITS = {
    "%": r"%|per ?cent\b|percent\b",
    "days": r"days?\b|d\b",
    "hours": r"hours?\b|hrs?\b|h\b",
    "weeks": r"weeks?\b|wks?\b",
    "months": r"months?\b|mos?\b",
    "years": r"years?\b|yrs?\b|y\b",
}
NOISE = [
    r"\b[A-Za-z]+(?:-[A-Za-z]+)*-\d+[A-Za-z]*\b",
    r"\b[A-Za-z]+\d+[A-Za-z]*\d*\b",
    r"\b\d{4}-nCoV\b",
    r"\b(?:19|20)\d{2}\b",
    r"\b9[05](?:\.\d+)?\s*%?\s*(?:CI|confidence|credible|UI)\b",
    r"\[[\d,\s;–-]+\]",
    r"\b(?:Fig(?:ure)?s?|Tables?|Refs?|Supplementary|eTable|Appendix)\.?\s*S?\d+[A-Za-z]?\b",
    r"\b[Pp]\s*[<=>≤≥]\s*0?[.·]\d+\b",
]
INTERVAL_LABEL = r"(?:[,;]?\s*\b9[05]\s*%?\s*(?:CI|CrI|UI|confidence|credible)\b|[,;]?\s*\b(?:CI|CrI|UI)\b)"
INTERVAL_TAIL = (r"\b9[05]\s*%\s*(?:CI|CrI|UI|confidence interval|credible interval)\s*[:=,]?\s*"
                 + NUMBER + r"\s*(?:-|–|—|to)\s*" + NUMBER)
UNIT_WORDS_AFTER_VALUE = r"(\s?%|\s?-?\s?(?:days?|weeks?|months?|years?)\b)?"
KEY_NUMBER = r"\d{1,3}(?:,\d{3})+(?:[.·]\d+)?|\d+(?:[.·]\d+)?"
KEY_UNITS = {
    "%": "%", "percent": "%", "per cent": "%", "day": "days", "days": "days", "week": "weeks", "weeks": "weeks",
    "month": "months", "months": "months", "year": "years", "years": "years", "hour": "hours", "hours": "hours",
    "h": "hours", "min": "min", "minutes": "min", "patient": "patients", "patients": "patients", "case": "cases",
    "cases": "cases", "death": "deaths", "deaths": "deaths", "participant": "participants",
    "participants": "participants", "people": "people", "person": "people", "persons": "people",
    "individuals": "people", "children": "children", "adults": "adults", "sample": "samples", "samples": "samples",
    "fold": "fold", "times": "fold", "kg": "kg", "g": "g", "mg": "mg", "ml": "ml", "mm": "mm", "cm": "cm", "km": "km",
    "°c": "°c", "point": "points", "points": "points", "copies": "copies",
}
FRACTION = r"(?iU)(?<![\d.])(\d+)\s*(?:/|of|out of)\s*(\d+)(?![\d.])"
# -------------------------------------------------------------------------------------------------------------------

NUMBER_START = r"(?<![\d.·])"
NUMBER_END = r"(?!\d|[.·∙⋅]\d)"
_FLAGS = "(?iuU)"
_RANGE_VALUE = _FLAGS + rf"(?<![\w.·])({NUMBER}){RANGE_JOIN}({NUMBER})(?![\d.·]){UNIT_WORDS_AFTER_VALUE}"
_SINGLE_VALUE = _FLAGS + rf"(?<![\w.·])({NUMBER}){UNIT_WORDS_AFTER_VALUE}"
_RANGE_TERM = _FLAGS + rf"^\s*(?:between\s+)?({NUMBER}){RANGE_JOIN}({NUMBER})(\s*-?\s*)(.*?)\s*$"
_NUMBER_TERM = rf"(?U)^\s*({THOUSANDS}|{NUMBER})(\s*-?\s*)(.*?)\s*$"
_KEY_UNIT = (r"(?:\s*-?\s*)(" + "|".join(sorted(KEY_UNITS, key=len, reverse=True)) + r")(?![A-Za-z])")
_KEY_RANGE = _FLAGS + rf"(?<![\w.·])({KEY_NUMBER})\s*(?:to|and|or|–|—|-)\s*({KEY_NUMBER}){_KEY_UNIT}"
_KEY_VALUE = _FLAGS + rf"(?<![\w.·])({KEY_NUMBER})(?:{_KEY_UNIT})?"
_NOISE = "(?U)" + "|".join(NOISE)
# A bracket with an interval estimate. Only the text in front of the label is kept (group 1), and only if it is more
# than an interval.
_INTERVAL_GROUP = (_FLAGS + r"[(\[](?:(?:\s*" + NUMBER + RANGE_JOIN + NUMBER + r"\s*[,;]?\s*|\s*)" + INTERVAL_LABEL
                   + r"|([^()\[\]]*?)" + INTERVAL_LABEL
                   + r"|[^()\[\]]*?\b(?:confidence|credible)\b)[^()\[\]]*[)\]]")


def _groups(text: Column, pattern: str, *idx: int) -> Column:
    """All matches as structs g1, g2, ... of the given groups."""
    arrays = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in idx]
    return F.arrays_zip(*arrays)


def _drop_zeros(n: Column) -> Column:
    return F.regexp_replace(n, r"(?<=\.\d{0,40}[1-9])0+$|\.0*$", "")


def _point(n: Column) -> Column:
    return F.translate(n, ",·∙⋅", "....")


def _number_key(raw: Column) -> Column:
    return (F.when(raw.rlike(rf"^{THOUSANDS}$"), F.regexp_replace(raw, ",", "")).otherwise(_drop_zeros(_point(raw))))


def numbers(c: Column) -> Column:
    """The numbers of a text, normalised: thousands separators and trailing zeros dropped, decimal point."""
    raw = F.regexp_extract_all(c, F.lit(rf"(?U){NUMBER_START}(?:{THOUSANDS}(?![\d.·])|{NUMBER})"), F.lit(0))
    return F.transform(raw, _number_key)


def posting_numbers(c: Column) -> Column:
    """The distinct numbers a tolerant value pattern can start with at some place of a text: a decimal comma separates
    two numbers here, as it does in the pattern. Used as the equi-join key in front of the pattern."""
    raw = F.regexp_extract_all(c, F.lit(rf"(?U){NUMBER_START}(?=(\d+(?:{DECIMAL_MARK}\d+)?){NUMBER_END})"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda n: _drop_zeros(_point(n))))


def strip_noise(c: Column) -> Column:
    """Remove digits that are not quantities: interval estimates, names with digits, years, marks, p values."""
    t = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), _INTERVAL_GROUP, " $1 "))
    t = F.regexp_replace(t, _FLAGS + INTERVAL_TAIL, " ")
    return collapse(F.regexp_replace(t, _NOISE, " "))


def canonical_unit(c: Column) -> Column:
    """One of %, days, hours, weeks, months, years; null for anything else."""
    def ladder(u: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(CANONICAL_UNITS.items()):
            out = F.when(u.rlike(rf"{_FLAGS}^\s*-?\s*(?:{pattern})$"), F.lit(name)).otherwise(out)
        return F.when(u != "", out)

    return let(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^-+", "")), ladder)


def unit_after(c: Column) -> Column:
    """Canonical unit written directly at the start of a text (after a value); null without one."""
    def ladder(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(CANONICAL_UNITS.items()):
            out = F.when(t.rlike(rf"{_FLAGS}^\s*-?\s*(?:{pattern})"), F.lit(name)).otherwise(out)
        return out

    return let(c, ladder)


def _value_unit(u: Column) -> Column:
    return let(strip(F.regexp_replace(strip(u), r"^-+", "")), lambda t: F.when(t.startswith("%"), F.lit("%")).otherwise(
        F.coalesce(canonical_unit(t), F.lit(""))))


def _with_unit(value: Column, unit: Column) -> Column:
    return F.concat(value, let(unit, lambda u: F.when(u == "%", u).when(u != "", F.concat(F.lit(" "), u)).otherwise(F.lit(""))))


def _specific(nums: Column, unit: Column) -> Column:
    """A bare small integer is no searchable value."""
    return (unit != "") | F.exists(nums, lambda n: F.contains(n, F.lit(".")) | n.rlike(r"(?U)^\d{4,}$"))


def stated_values(c: Column) -> Column:
    """array<struct<term, nums>>: every quantity of a claim text, ranges first and whole, then single values."""
    return let(strip_noise(c), _stated)


def _stated(t: Column) -> Column:
    ranges = F.transform(_groups(t, _RANGE_VALUE, 1, 2, 3), lambda g: F.struct(
        g["g1"].alias("a"), g["g2"].alias("b"), _value_unit(g["g3"]).alias("unit")))
    ranges = F.filter(ranges, lambda g: _specific(
        F.array(F.regexp_replace(g["a"], ",", "."), F.regexp_replace(g["b"], ",", ".")), g["unit"]))
    ranges = F.transform(ranges, lambda g: F.struct(
        _with_unit(F.concat(g["a"], F.lit(" to "), g["b"]), g["unit"]).alias("term"),
        numbers(F.concat_ws(" ", g["a"], g["b"])).alias("nums")))
    rest = F.regexp_replace(t, _RANGE_VALUE, " ")
    single = F.transform(_groups(rest, _SINGLE_VALUE, 1, 2), lambda g: F.struct(
        F.regexp_replace(g["g1"], "·", ".").alias("num"), _value_unit(g["g2"]).alias("unit")))
    single = F.filter(single, lambda g: _specific(F.array(F.regexp_replace(g["num"], ",", "")), g["unit"]))
    single = F.transform(single, lambda g: F.struct(
        _with_unit(g["num"], g["unit"]).alias("term"), numbers(g["num"]).alias("nums")))
    return F.concat(ranges, single)


def old_value_terms(old: Column, new: Column, k: int | None = None) -> Column:
    """Terms for the values of the old text whose numbers are not all in the new text; order kept; with k the first ones."""
    kept = let(strip_noise(new), lambda t: F.concat(
        F.flatten(F.transform(_stated(t), lambda v: v["nums"])), numbers(t)))
    changed = let(kept, lambda have: F.filter(stated_values(old), lambda v: F.size(F.array_except(v["nums"], have)) > 0))
    terms = F.array_distinct(F.transform(changed, lambda v: v["term"]))
    return terms if k is None else F.slice(terms, 1, k)


def claim_values(c: Column) -> Column:
    """Distinct "number unit" keys a text states, sorted; both ends of a range share the unit."""
    units = F.create_map(*[F.lit(x) for pair in KEY_UNITS.items() for x in pair])

    def key(num: Column, unit: Column) -> Column:
        n = _drop_zeros(F.regexp_replace(F.regexp_replace(num, ",", ""), "·", "."))
        return _with_unit(n, F.coalesce(F.element_at(units, F.lower(unit)), F.lit("")))

    def keys(s: Column) -> Column:
        pairs = _groups(s, _KEY_RANGE, 1, 2, 3)
        ends = F.flatten(F.transform(pairs, lambda g: F.array(key(g["g1"], g["g3"]), key(g["g2"], g["g3"]))))
        rest = F.regexp_replace(s, _KEY_RANGE, " ")
        single = F.transform(_groups(rest, _KEY_VALUE, 1, 2), lambda g: key(g["g1"], g["g2"]))
        return F.array_sort(F.array_distinct(F.concat(ends, single)))

    return let(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " ", " "), _NOISE, " "), keys)


def found_values(stated: Column, keys: Column) -> Column:
    """Claim keys a sentence states: the same number and unit, or the same number without a unit."""
    bare = F.filter(stated, lambda v: ~F.contains(v, F.lit(" ")) & ~v.endswith("%"))
    return let(bare, lambda b: F.array_sort(F.filter(keys, lambda k: F.array_contains(stated, k)
                                                     | F.array_contains(b, F.substring_index(k, " ", 1)))))


def old_or_new(stated: Column, old_keys: Column, new_keys: Column) -> Column:
    """Verdict of a sentence's keys against the old and the new text's keys, with the values found."""
    def verdict(v: Column) -> Column:
        has_old, has_new = F.size(v["old"]) > 0, F.size(v["new"]) > 0
        label = (
            F.when(has_old & has_new, F.lit("mentions_both"))
            .when(has_old, F.lit("uses_old_value"))
            .when(has_new, F.lit("uses_current_value"))
            .when(F.size(v["same"]) > 0, F.lit("unchanged_value"))
            .otherwise(F.lit("cannot_tell"))
        )
        return F.struct(label.alias("verdict"), v["old"].alias("old_values_found"), v["new"].alias("new_values_found"))

    return let(F.struct(
        found_values(stated, F.array_except(old_keys, new_keys)).alias("old"),
        found_values(stated, F.array_except(new_keys, old_keys)).alias("new"),
        found_values(stated, F.array_intersect(old_keys, new_keys)).alias("same")), verdict)


# ---- Terms: reading, spellings, patterns ---------------------------------------------------------------------------
def read_term(c: Column) -> Column:
    """struct(kind, a, b, unit): kind is range (two numbers), number (one) or words."""
    def parts(r: Column) -> Column:
        is_range = r["is_range"]
        is_num = (r["num"] != "") & ~r["num"].rlike(rf"^{THOUSANDS}$")
        kind = F.when(is_range, F.lit("range")).when(is_num, F.lit("number")).otherwise(F.lit("words"))
        a = (F.when(is_range, _point(F.regexp_extract(r["c"], _RANGE_TERM, 1))).when(is_num, _point(r["num"]))
             .otherwise(strip(r["c"])))
        b = F.when(is_range, _point(F.regexp_extract(r["c"], _RANGE_TERM, 2)))
        unit = (F.when(is_range, F.regexp_extract(r["c"], _RANGE_TERM, 4))
                .when(is_num, F.regexp_extract(r["c"], _NUMBER_TERM, 3)).otherwise(F.lit("")))
        return F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"), unit.alias("unit"))

    return let(F.struct(c.alias("c"), c.rlike(_RANGE_TERM).alias("is_range"),
                        F.regexp_extract(c, _NUMBER_TERM, 1).alias("num")), parts)


def _unit_of(t: Column) -> Column:
    return F.when(t["kind"] != "words", canonical_unit(t["unit"]))


def term_unit(c: Column) -> Column:
    """Canonical unit written in the term itself."""
    return let(read_term(c), _unit_of)


def value_term(c: Column) -> Column:
    """The term without its unit; text after the number that is no known unit stays."""
    return let(read_term(c), lambda t: _bare_value(c, t, _unit_of(t)))


def _bare_value(c: Column, t: Column, own_unit: Column) -> Column:
    known = (t["unit"] == "") | own_unit.isNotNull()
    return (
        F.when((t["kind"] == "range") & known, F.concat_ws(" to ", t["a"], t["b"]))
        .when((t["kind"] == "number") & known, t["a"])
        .otherwise(strip(c))
    )


def _number_spellings(n: Column) -> Column:
    return let(_drop_zeros(n), lambda base: F.array_distinct(F.concat(F.array(n, base), F.when(
        F.contains(base, F.lit(".")),
        F.array(F.regexp_replace(base, r"\.", "·"), F.concat(base, F.lit("0"))),
    ).otherwise(F.array(F.concat(base, F.lit(".0")))))))


def _unit_spellings(unit: Column) -> Column:
    out = F.when(unit == "", F.array(F.lit(""))).otherwise(F.array(
        F.when(unit.rlike("^[- %]"), unit).otherwise(F.concat(F.lit(" "), unit))))
    for name, forms in reversed(UNIT_SUFFIXES.items()):
        out = F.when(F.lower(unit) == name, F.array(*[F.lit(f) for f in forms])).otherwise(out)
    return out


def term_spellings(c: Column) -> Column:
    """All spellings of a term, the term itself first, no repeats."""
    def with_units(values: Column, unit: Column) -> Column:
        return let(_unit_spellings(unit), lambda units: F.flatten(
            F.transform(values, lambda v: F.transform(units, lambda u: F.concat(v, u)))))

    def range_values(t: Column) -> Column:
        ends = F.struct(_number_spellings(t["a"]).alias("lo"), _number_spellings(t["b"]).alias("hi"))
        return let(ends, lambda e: F.flatten(F.flatten(F.transform(
            F.array(*[F.lit(s) for s in RANGE_SPELLINGS]),
            lambda s: F.transform(e["lo"], lambda a: F.transform(e["hi"], lambda b: F.concat(a, s, b)))))))

    def all_forms(t: Column) -> Column:
        values = (
            F.when(t["kind"] == "range", range_values(t))
            .when((t["kind"] == "number") & F.contains(t["a"], F.lit(".")), _number_spellings(t["a"]))
            .when(t["kind"] == "number", F.array(t["a"]))
            .otherwise(F.array().cast("array<string>"))
        )
        return F.array_distinct(F.concat(F.array(strip(c)), with_units(values, t["unit"])))

    return let(read_term(c), all_forms)


def value_spellings(c: Column) -> Column:
    """Spellings of the bare value, as a full-text index is asked for them."""
    return let(value_term(c), term_spellings)


def _number_pattern(n: Column) -> Column:
    def body(base: Column) -> Column:
        whole, dec = F.substring_index(base, ".", 1), F.substring_index(base, ".", -1)
        return F.when(F.contains(base, F.lit(".")), F.concat(whole, F.lit(DECIMAL_MARK), dec, F.lit("0*"))).otherwise(
            F.concat(whole, F.lit(f"(?:{DECIMAL_MARK}0+)?")))

    return F.concat(F.lit(NUMBER_START), let(_drop_zeros(n), body), F.lit(NUMBER_END))


def _unit_pattern(unit: Column) -> Column:
    known = {name: (r"\s*" if name == "%" else r"\s*-?\s*") + pattern for name, pattern in UNIT_PATTERNS.items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(unit == "", F.lit("")).otherwise(F.coalesce(
        F.element_at(table, F.lower(unit)), F.concat(F.lit(r"\s*-?\s*"), _words_pattern(unit))))


def _words_pattern(c: Column) -> Column:
    words = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, escape_regex), r"\s*-?\s*")


def term_pattern(c: Column) -> Column:
    """One tolerant Java pattern that matches every spelling of a term."""
    return let(read_term(c), _pattern_of)


def _pattern_of(t: Column) -> Column:
    body = F.when(t["kind"] == "words", _words_pattern(t["a"])).otherwise(F.concat(
        _number_pattern(t["a"]), F.when(t["kind"] == "range", F.concat(F.lit(RANGE_JOIN), _number_pattern(t["b"]))).otherwise(F.lit(""))))
    return F.concat(F.lit(_FLAGS), body, _unit_pattern(t["unit"]))


def _number_of(t: Column) -> Column:
    return F.when(t["kind"] != "words", _drop_zeros(t["a"]))


def _matched_value(c: Column) -> Column:
    return F.when(F.size(numbers(c)) > 0, value_term(c)).otherwise(c)


def value_pattern(c: Column) -> Column:
    """Pattern of the bare value for numeric terms, of the whole term otherwise."""
    return let(_matched_value(c), term_pattern)


def join_number(c: Column) -> Column:
    """Key of the posting join: the first number of a term whose pattern starts with a bounded number. Null for terms
    matched by words (a thousands group, free text), which have no such key."""
    return let(_matched_value(c), lambda v: let(read_term(v), _number_of))


# ---- Matches read as quantities -------------------------------------------------------------------------------------
def in_range(text: Column, start: Column, end: Column) -> Column:
    """A point value written as an end of a range is another quantity."""
    lead, tail = before(text, start, 20), after(text, end)
    return (lead.rlike(rf"{_FLAGS}{NUMBER}\s*(?:-?\s*to|[-–—−])\s*$")
            | tail.rlike(rf"{_FLAGS}^{RANGE_JOIN_NO_AND}{NUMBER}"))


def _first_number(c: Column) -> Column:
    return F.get(numbers(c), F.lit(0)).cast("double")


def quantity_at(text: Column, start: Column, end: Column) -> Column:
    """struct(values, computed): the whole quantity a match belongs to. A fraction is read as its percentage."""
    overlap = F.filter(
        find_all(text, F.lit(FRACTION)),
        lambda m: (m["start"] < end) & (start < m["end"])
        & (F.regexp_extract(m["match"], FRACTION, 2).cast("double") != 0))

    def from_fraction(m: Column) -> Column:
        return F.array(100 * F.regexp_extract(m, FRACTION, 1).cast("double") / F.nullif(
            F.regexp_extract(m, FRACTION, 2).cast("double"), F.lit(0.0)))

    def from_text(v: Column) -> Column:
        first = F.get(v["own"], F.lit(0))
        return (
            F.when(F.size(v["own"]) >= 2, F.slice(v["own"], 1, 2))
            .when(F.size(v["own"]) == 0, v["own"])
            .when(v["prev"] != "", F.array(_first_number(v["prev"]), first))
            .when(v["next"] != "", F.array(first, _first_number(v["next"])))
            .otherwise(F.array(first))
        )

    around = F.struct(
        F.transform(numbers(F.substring(text, start + 1, end - start)), lambda n: n.cast("double")).alias("own"),
        F.regexp_extract(before(text, start, 24), rf"{_FLAGS}({NUMBER})\s*(?:-?\s*to|and|[-–—−])\s*$", 1).alias("prev"),
        F.regexp_extract(after(text, end), rf"{_FLAGS}^\s*(?:-?\s*to|and|[-–—−])\s*({NUMBER})", 1).alias("next"))
    return let(F.get(overlap, F.lit(0))["match"], lambda m: F.struct(
        F.when(m.isNotNull(), from_fraction(m)).otherwise(let(around, from_text)).alias("values"),
        m.isNotNull().alias("computed")))


def round_half_even(x: Column, digits: Column) -> Column:
    """Round a non-negative double to a number of decimals on its exact binary value; exact ties go to even.

    The value is scaled by a power of two to an integer, so the comparison with the half is exact decimal arithmetic."""
    d38 = "decimal(38,0)"
    bits = F.when(x < 1, F.lit(60)).when(x < 512, F.lit(53)).otherwise(F.lit(40))

    def scaled(scale: Column) -> Column:
        ten = F.pow(F.lit(10), digits).cast("long").cast("decimal(9,0)")
        return F.struct(scale.cast("decimal(19,0)").alias("unit"),
                        ((x * scale).cast("long").cast("decimal(19,0)") * ten).cast(d38).alias("value"))

    def divided(v: Column) -> Column:
        rest = F.pmod(v["value"], v["unit"].cast(d38)).cast(d38)
        return F.struct(((v["value"] - rest).cast(d38).cast("double") / v["unit"].cast("double")).alias("whole"),
                        (rest * 2).cast(d38).alias("twice"), v["unit"].alias("unit"))

    def rounded(v: Column) -> Column:
        up = (v["twice"] > v["unit"]) | ((v["twice"] == v["unit"]) & (v["whole"] % 2 == 1))
        return (v["whole"] + up.cast("int")) / F.pow(F.lit(10.0), digits)

    return let(F.pow(F.lit(2.0), bits), lambda sc: let(scaled(sc), lambda v: let(divided(v), rounded)))


def target_quantities(terms: Column) -> Column:
    """The old values as quantities: array<struct<values, decimals>> for the numeric terms."""
    return F.transform(F.filter(terms, lambda t: F.size(numbers(t)) > 0), lambda t: let(
        numbers(value_term(t)), lambda ns: F.struct(
            F.transform(ns, lambda n: n.cast("double")).alias("values"),
            F.transform(ns, lambda n: F.when(F.contains(n, F.lit(".")), F.length(F.substring_index(n, ".", -1)))
                        .otherwise(F.lit(0))).alias("decimals"))))


def same_quantity(found: Column, want: Column) -> Column:
    """Equal quantities; a computed one is compared at the precision the wanted value is stated with."""
    def equal(vals: Column) -> Column:
        same = F.zip_with(vals, want["values"], lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.forall(same, lambda ok: ok)

    vals = F.when(found["computed"], F.zip_with(found["values"], want["decimals"], round_half_even)).otherwise(found["values"])
    return (F.size(want["values"]) > 0) & (F.size(found["values"]) == F.size(want["values"])) & let(vals, equal)


def property_pattern(terms: Column) -> Column:
    """Pattern of any property phrase; words are joined by spaces or hyphens and a letter-digit boundary may hold one
    space. Null without a phrase."""
    def word(w: Column) -> Column:
        parts = F.regexp_extract_all(w, F.lit(r"(?U)[^\W\d_]+|\d+|\S"), F.lit(0))
        return F.array_join(F.transform(parts, escape_regex), r"\s?")

    def phrase(p: Column) -> Column:
        words = F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")
        return F.array_join(F.transform(words, word), r"[\s-]+")

    clean = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda p: F.lower(strip(p))),
                     lambda p: p != "")
    return let(clean, lambda ps: F.when(F.size(ps) > 0, F.concat(
        F.lit(_FLAGS + r"\b(?:"), F.array_join(F.transform(ps, phrase), "|"), F.lit(r")\b"))))


def match_rules(terms: Column, unit: Column, proposed: Column) -> Column:
    """Per term what the sentence test needs: pattern, join key, wanted unit, and the kind flags."""
    props = F.transform(F.coalesce(proposed, F.array().cast("array<string>")), lambda p: F.lower(strip(p)))
    known = F.when(unit.isin(*CANONICAL_UNITS, "none"), unit)

    def rule(r: Column, v: Column) -> Column:
        return F.struct(
            r["term"].alias("term"),
            _pattern_of(v).alias("pattern"),
            _number_of(v).alias("number"),
            F.when(v["kind"] == "words", v["a"]).alias("words"),
            r["numeric"].alias("numeric"),
            F.coalesce(r["own"], known).alias("want"),
            r["own"].isNotNull().alias("has_unit"),
            ((v["kind"] != "range") & ~r["strict"]).alias("point"),
            r["strict"].alias("strict"))

    def read(t: Column, ps: Column) -> Column:
        facts = let(read_term(t), lambda p: let(_unit_of(p), lambda own: F.struct(
            t.alias("term"), (F.size(numbers(t)) > 0).alias("numeric"), own.alias("own"),
            F.array_contains(ps, F.lower(strip(t))).alias("strict"), _bare_value(t, p, own).alias("value"))))
        return let(facts, lambda r: let(read_term(F.when(r["numeric"], r["value"]).otherwise(t)), lambda v: rule(r, v)))

    return let(props, lambda ps: F.transform(terms, lambda t: read(t, ps)))


def old_quantities(terms: Column, proposed: Column) -> Column:
    """Quantities of the terms that were not proposed later."""
    props = F.transform(F.coalesce(proposed, F.array().cast("array<string>")), lambda p: F.lower(strip(p)))
    return target_quantities(F.filter(terms, lambda t: ~F.array_contains(props, F.lower(strip(t)))))


def holds_quantity(text: Column, context: Column, rules: Column, wanted: Column, prop: Column) -> Column:
    """A sentence holds the old value as the target's quantity: value, unit and measured property must agree."""
    where = F.concat_ws(" ", text, F.coalesce(context, F.lit("")))

    def passes(rule: Column, m: Column, unit: Column, has_prop: Column) -> Column:
        equal = let(quantity_at(text, m["start"], m["end"]), lambda q: F.exists(wanted, lambda w: same_quantity(q, w)))
        return (
            F.when(~rule["numeric"], ~rule["strict"])
            .when(rule["point"] & in_range(text, m["start"], m["end"]), F.lit(False))
            .when(unit.isNotNull() & rule["want"].isNotNull() & (unit != rule["want"]), F.lit(False))
            .when(rule["strict"], equal & F.coalesce(has_prop, F.lit(True)))
            .when(unit.isNotNull(), F.lit(True))
            .when(has_prop.isNotNull(), has_prop)
            .otherwise(~rule["has_unit"])
        )

    def any_match(has_prop: Column) -> Column:
        return F.exists(rules, lambda r: F.exists(find_all(text, r["pattern"]), lambda m: let(
            unit_after(after(text, m["end"], 16)), lambda unit: passes(r, m, unit, has_prop))))

    return F.coalesce(let(F.when(prop.isNotNull(), F.regexp_like(where, prop)), any_match), F.lit(False))
