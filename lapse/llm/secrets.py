"""Secret scan: fixed patterns plus sliding-window Shannon entropy over candidate strings.

Base kinds are regular expressions (assignment, access key, hex). The entropy
kind takes candidate strings (long runs of key characters), slides a window of
fixed width over each, keeps the counts of the characters in the window by one
increment and one decrement a step, and from them the entropy of the window
within each character class that covers it. Windows at or above the threshold
of their class are merged to a span; candidates on the allow list are skipped.

Everything is a row expression over one text: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, with the least length of what must be that long.
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so a shorter one holds no match either
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy kind.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Allow list: whole candidates of these forms, and those of which every part
#: between joining marks is a plain word or a short number, are no secrets; one
#: part, and no more, may be a word with a number.
ALLOW = (r"^[A-Z]+$", r"^[0-9]+$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
JOINTS, PLAIN = r"[-_/=+]+", r"^([A-Za-z]?[a-z]{0,14}|[A-Z]{1,15}|[0-9]{1,4})$"
NUMBERED = r"^([A-Za-z][a-z]{0,14}|[A-Z]{1,15})[0-9]{1,4}$"
#: Character classes: name, characters, entropy in bits that a window of 20 within the class needs.
CLASSES = (("hex", "0123456789abcdef", 3.0),
           ("upper hex", "0123456789ABCDEF", 3.0),
           ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.6),
           ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.8))

_SPAN = "array<struct<s:int,e:int,k:int,body:string>>"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as (s, e, k, body) in code points.

    ``split`` gives what lies between the matches, so the starts are running
    sums of both lengths. Texts without a match take the cheap branch."""
    none = F.array().cast(_SPAN)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        span = F.struct(s.alias("s"), e.alias("e"), F.lit(KINDS.index(kind)).alias("k"), x["hit"].alias("body"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).cast(_SPAN).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("hit"), g.alias("gap")))
    walk = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walk).otherwise(none)


#: All characters that any class holds; a count takes five bits, twelve counts a long.
LETTERS = "".join(dict.fromkeys("".join(chars for _, chars, _ in CLASSES)))
_BITS, _EACH, _ONE = 5, 12, 1 << 40
_RANGES = "array<struct<s:int,e:int>>"


def _lookup(values: list[int], kind: str, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def window_ranges(word: Column, width: int) -> Column:
    """Ranges (0-based start, end exclusive) of ``word`` covered by windows that lie within a class and reach its bits.

    One walk for all classes, since a window's entropy depends on its counts
    alone. A step touches two counts, packed to a few longs: that of the
    entering character goes up, that of the leaving one down, and h, the sum of
    n log2 n (as whole multiples of 2^-40, so that nothing drifts), changes by
    those two. The window's entropy is log2 width - h / width; a class covers it
    if the last ``width`` characters are all in the class, which a running
    length per class tells. Ranges grow in place; only a new one is appended."""
    if width >= 1 << _BITS:
        raise ValueError(f"windows of at most {(1 << _BITS) - 1} characters")
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c))  # 0: in no class
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), width), codes), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    longs = -(-len(LETTERS) // _EACH)
    places = [-1] + [i // _EACH for i in range(len(LETTERS))]
    shifts = [0] + [_BITS * (i % _EACH) for i in range(len(LETTERS))]
    members = [0] + [sum(1 << j for j, (_, chars, _) in enumerate(CLASSES) if c in chars) for c in LETTERS]
    nlog = [round(n * math.log2(n) * _ONE) if n > 1 else 0 for n in range(width + 2)]
    most = [math.floor((math.log2(width) - least + 1e-9) * width * _ONE) for _, _, least in CLASSES]
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0).cast("long").alias("h"),
                     F.array_repeat(F.lit(0), len(CLASSES)).alias("run"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(_RANGES).alias("out"))

    def count(n, code):
        held = F.call_function("shiftright", F.get(n, _lookup(places, "int", code)), _lookup(shifts, "int", code))
        return held.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def moved(n, code, by):
        """The counts and what the sum of n log2 n gains when a character comes (by = 1) or goes (by = -1)."""
        had = count(n, code)
        place, one = _lookup(places, "int", code), _lookup([0] + [1 << x for x in shifts[1:]], "long", code)
        return F.when(code > 0, F.transform(n, lambda c, k: F.when(k == place, c + by * one).otherwise(c))).otherwise(n), \
            F.when(code > 0, _lookup(nlog, "long", had + by) - _lookup(nlog, "long", had)).otherwise(F.lit(0).cast("long"))

    def enter(acc, x):
        less, fall = moved(acc["n"], x["old"], -1)
        # the second change reads the counts after the first: bound once, not written out twice
        both = F.transform(F.array(less), lambda n: F.struct(moved(n, x["new"], 1)[0].alias("n"), moved(n, x["new"], 1)[1].alias("rise")))[0]
        return F.transform(F.array(F.struct(both.alias("b"), (acc["h"] + fall).alias("h"))), lambda y: after(acc, x, y["b"]["n"], y["h"] + y["b"]["rise"]))[0]

    def after(acc, x, n, h):
        i = acc["i"] + 1
        mask = _lookup(members, "int", x["new"])
        run = F.transform(acc["run"], lambda r, j: F.when(F.call_function("shiftright", mask, j).bitwiseAND(F.lit(1)) == 1, r + 1).otherwise(0))
        bare = F.struct(i.alias("i"), n.alias("n"), h.alias("h"), run.alias("run"))
        return F.transform(F.array(bare), lambda y: closed(acc, y))[0]

    def closed(acc, y):
        hit = F.lit(False)
        for j, limit in enumerate(most):
            hit = hit | ((y["run"][j] >= width) & (y["h"] <= F.lit(limit)))
        fresh = hit & (y["i"] - width > acc["e"])
        full = F.when(fresh & (acc["e"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])
        return F.struct(y["i"].alias("i"), y["n"].alias("n"), y["h"].alias("h"), y["run"].alias("run"), F.when(fresh, y["i"] - width).otherwise(acc["s"]).alias("s"),
                        F.when(hit, y["i"]).otherwise(acc["e"]).alias("e"), full.alias("out"))

    def done(acc):
        return F.when(acc["e"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])

    return F.aggregate(F.filter(steps, lambda x: x["new"].isNotNull()), start, enter, done)


def _entropy(candidates: Column, width: int) -> Column:
    """The entropy spans of the candidate strings of one text."""
    def allowed(w):
        others = F.filter(F.split(w, JOINTS), lambda p: ~p.rlike(PLAIN))
        listed = (F.size(others) <= 1) & F.forall(others, lambda p: p.rlike(NUMBERED))
        for pattern in ALLOW:
            listed = listed | w.rlike(pattern)
        return listed

    def spans(x):
        span = lambda r: F.struct((x["s"] + r["s"]).alias("s"), (x["s"] + r["e"]).alias("e"), F.lit(3).alias("k"), F.lit("").alias("body"))
        return F.transform(window_ranges(x["body"], width), span).cast(_SPAN)

    return F.flatten(F.transform(F.filter(candidates, lambda x: ~allowed(x["body"])), spans))


def scan_secrets(df: DataFrame, key: str, text: str = "text", width: int = 20, least_value: int = 6) -> DataFrame:
    """``key``, counts of the base kinds, ``base_sha256``, ``spans`` and ``findings`` of every row.

    ``findings`` is an array of (kind, start, end) by start, then kind, in code
    points, end exclusive; ``spans`` the same as text. Base matches shorter
    than asked for are dropped after matching. Entropy spans inside a base
    span add nothing and are left out. A null text counts as empty, which has
    no finding (the SHA-256 of the empty string); repeated rows and null keys
    come out as they came in; other columns of ``df`` are not read.
    """
    t = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    assign = F.filter(_spans(F.col("_t"), ASSIGN, "assign"),
                      lambda x: F.length(F.regexp_extract(x["body"], ASSIGN, 2)) >= least_value)
    t = t.select("_k", assign.alias("_assign"), _spans(F.col("_t"), ACCESS, "access").alias("_access"),
                 _spans(F.col("_t"), HEX, "hex").alias("_hex"), _spans(F.col("_t"), CANDIDATE, "entropy").alias("_cand"))
    t = t.withColumn("_base", F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), _plain)))
    found = F.filter(_entropy(F.col("_cand"), width), lambda x: ~F.exists("_base", lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    t = t.withColumn("_all", F.when(F.size("_cand") == 0, F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", F.transform(found, _plain)))))
    count = lambda c: F.size(c).cast("long")
    return t.select(F.col("_k").alias(key), count("_assign").alias("n_assign"), count("_access").alias("n_access"),
                    count("_hex").alias("n_hex"), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"),
                    F.transform("_all", lambda x: F.struct(_name(x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("findings"))


def _plain(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))


def _name(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
