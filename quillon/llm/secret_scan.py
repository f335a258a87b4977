"""Secret scans, in DataFrame operations only: known forms, and strings of high entropy.

A candidate string is a long run of key characters. A window slides over it; counts of the
characters change by one in and one out, and with them the sum of n * log2(n) that gives the
window's Shannon entropy. Windows of hexadecimal digits, candidates of letters and the rest have
thresholds of their own. Candidates on the allow-list (letters in the form of words, numbers, UUIDs)
are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known forms, as regular expressions.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE, MIN_ACCESS = 8, 16

KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy in bits a character of a window: of hexadecimal digits in one case with a letter, in a candidate of letters and marks, else.
HEX_BITS, LETTER_BITS, MIXED_BITS = 3.0, 3.4, 3.6
_CONSONANT = "[BCDFGHJKLMNPQRSTVWXZbcdfghjklmnpqrstvwxz]"
#: Letters, each with those that hardly follow it in words.
_HARDLY = "bqxz cbfgjpvwx dqx fbcdghjkmnpqvwxz gjqvxz hjqvxz jbcdfghklmnpqrstvwxyz kjqvxz lx mxz pjqvxz qbcdfghjklmnoprstvwxyz sx tqx vbcdfghjklmnpqstwxz wjqvxz xbdgjklmnrsvwz yq zbcdfghjklmnpqrstvwx"
_RARE = "|".join(f"{x[0]}[{x[1:]}]" for w in _HARDLY.split() for x in (w, w.upper()))
#: Letters and marks in the form of words: no rare pairs, no run of five consonants or two of four, at most one word of a single letter in camel case.
#: No group is repeated without bound: the JVM's matcher would recurse for each turn of it.
WORDS = rf"(?=[A-Za-z][A-Za-z+/_=-]*+$)(?!.*?(?:{_RARE}))(?!.*?{_CONSONANT}{{5}})(?!.*?{_CONSONANT}{{4}}.*?{_CONSONANT}{{4}})(?!(?:.*?[a-z][A-Z](?:[A-Z]|[a-z][A-Z])){{2}}).*"
#: Never secrets: words joined by marks, numbers, runs of one mark, UUIDs.
ALLOWED = rf"^({WORDS}|[0-9+/_=-]+|[+/_=-]*|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}})$"

#: Elements of a fold that appends to an array.
RUN = 64
#: Counts of the window's characters, five bits each, twelve in a long.
_BITS, _FIELDS = 5, 12
_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: what stands in a lambda is else computed at each call."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, fold) -> Column:
    """The fold of each element with all before it, for an array of int and sum or greatest.

    Folds of RUN elements at a time and of the runs' totals, as appending copies an array.
    """

    def along(xs, at):
        return F.aggregate(xs, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, v: _bound(fold(s["at"], v), lambda x: F.struct(x.alias("at"), F.array_append(s["out"], x).alias("out"))), lambda s: s["out"])

    def runs(xs):
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(xs, i + 1, RUN))
        return _bound(cut, totals)

    def totals(cut):
        each = F.transform(cut, lambda x: F.aggregate(x, F.lit(0), fold))
        return _bound(along(each, F.lit(0)), lambda ends: F.flatten(F.transform(cut, lambda x, i: along(x, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))))))

    return _bound(values, runs)


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, the kind and the group's text."""
    between = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), value.alias("v"))

    def spans(rows):
        ends = _running(F.transform(rows, lambda r: F.length(r["b"]) + F.length(r["w"])), lambda a, b: a + b)
        return F.zip_with(rows, ends, lambda r, end: F.struct((end - F.length(r["w"])).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), r["v"].alias("value")))

    return _bound(rows, spans)


def _found(text: Column, has: Column, pattern: str, kind: int, group: int = 0) -> Column:
    return F.when(has, _matches(text, pattern, kind, group)).otherwise(_none())


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Struct of lo and hi: first character of the first and past the last of the windows whose entropy passes; -1 if none.

    Counts of the lowercase and uppercase hexadecimal characters and of the digits in a window choose
    its threshold; a value of one kind alone has that kind's.
    """
    alone = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).when(~value.rlike("[0-9]"), F.lit(LETTER_BITS)).otherwise(F.lit(MIXED_BITS))
    upper, lower, digit = (lambda c, a=ALPHABET.index(x), n=n: c.between(a + 1, a + n).cast("int") for x, n in (("A", 6), ("a", 6), ("0", 10)))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _FIELDS)).alias("n"), *[F.lit(0).alias(x) for x in ("upper", "lower", "digit")], F.lit(0.0).alias("s"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    size = F.log2(F.lit(float(window)))
    word, shift = (lambda c: F.floor((c - 1) / _FIELDS).cast("int")), (lambda c: (c - 1) % _FIELDS * _BITS)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    count = lambda n, c: F.call_function("shiftright", F.get(n, word(c)), shift(c)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def step(codes, alone, state, at):
        into, first = F.element_at(codes, at), at > window
        out = F.when(first, F.element_at(codes, F.greatest(at - window, F.lit(1)))).otherwise(F.lit(0))
        leaving = F.when(first, count(state["n"], F.greatest(out, F.lit(1)))).otherwise(F.lit(0))
        entering = count(state["n"], into) - (into == out).cast("int")
        s = state["s"] - F.when(first, _weight(leaving) - _weight(leaving - 1)).otherwise(F.lit(0.0)) + _weight(entering + 1) - _weight(entering)
        n = F.transform(state["n"], lambda v, i: v + F.when(i == word(into), one(into)).otherwise(F.lit(0)) - F.when(first & (i == word(out)), one(F.greatest(out, F.lit(1)))).otherwise(F.lit(0)))
        kinds = [state[x] + kind(into) - kind(out) for x, kind in (("upper", upper), ("lower", lower), ("digit", digit))]
        a, b, d = kinds
        hexes = (d < window) & ((a + d == window) | (b + d == window))
        passes = (at >= window) & (size - s / window >= F.when(hexes, F.least(alone, F.lit(HEX_BITS))).otherwise(alone))
        return F.struct(n.alias("n"), *[k.alias(x) for k, x in zip(kinds, ("upper", "lower", "digit"), strict=True)], s.alias("s"), F.when(passes & (state["lo"] < 0), at - window).otherwise(state["lo"]).alias("lo"), F.when(passes, at).otherwise(state["hi"]).alias("hi"))

    def slide(v):
        return F.aggregate(F.sequence(F.lit(1), F.size(v["codes"])), start, lambda state, at: step(v["codes"], v["alone"], state, at), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _bound(F.struct(codes.alias("codes"), alone.alias("alone")), slide)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, end in code points, end exclusive, and kind, an index of KINDS) of every row, sorted by start, then kind.

    A null text is empty and has none. Spans of the known forms always stay; a string of high
    entropy inside one of them is not told again. Rows are independent, so repeated rows repeat.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    assign = F.filter(_found(t, t.rlike(r"(?i:password|passwd|secret|token|api_?key)"), ASSIGN, 0, 1), lambda x: F.length(x["value"]) >= MIN_VALUE)
    access = F.filter(_found(t, t.contains("AKIA"), ACCESS, 1), lambda x: F.length(x["value"]) >= MIN_ACCESS)
    hexes = _found(t, t.rlike("[0-9a-f]{32}"), HEX, 2)
    runs = F.filter(_found(t, t.rlike(CANDIDATE), CANDIDATE, 3), lambda x: ~x["value"].rlike(ALLOWED))
    base = docs.select("doc_id", F.concat(assign, access, hexes).alias("base"), runs.alias("runs"))

    rated = F.transform("runs", lambda x: F.struct(x["start"].alias("at"), window_entropy(x["value"]).alias("e")))
    narrowed = F.transform(rated, lambda r: F.struct((r["at"] + r["e"]["lo"]).alias("start"), (r["at"] + r["e"]["hi"]).alias("end"), F.lit(3).alias("kind"), (r["e"]["lo"] >= 0).alias("passes")))
    # of spans by start, known ones first, one lies within a known one if those up to it reach its end
    known = F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("new"), x["kind"].alias("kind"), x["end"].alias("end")))
    fresh = F.transform(F.filter(narrowed, lambda e: e["passes"]), lambda e: F.struct(e["start"].alias("start"), F.lit(1).alias("new"), e["kind"].alias("kind"), e["end"].alias("end")))

    def told(spans):
        reach = _running(F.transform(spans, lambda x: F.when(x["new"] == 0, x["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
        both = F.zip_with(spans, reach, lambda x, r: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), ((x["new"] == 0) | (r < x["end"])).alias("stays")))
        return F.array_sort(F.filter(both, lambda x: x["stays"]))

    spans = _bound(F.array_sort(F.concat(known, fresh)), told)
    return base.select("doc_id", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text (kind:start:end, comma-joined)."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
