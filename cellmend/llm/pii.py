"""Operator 2: personal data and secrets by generators, boosted trees and calibrated thresholds.

DataFrame functions only. Exact patterns give the base spans (email, ip, card, phone), each
kind leftmost and non-overlapping, then checked; they always stay. High-recall generators
propose further spans, which overlap one another and the base spans:

* every window of up to seven neighbouring digit groups of a run, as a card, an ip or a phone;
* what stands around an at sign, written out or in brackets, as an email;
* opaque runs of letters and digits, and what is assigned to a name like `token`, as a secret.

A proposal is described by its format and its context in small integers, and it has a label
from a view that its features don't hold: a card's is Luhn's check, an ip's its parts' range, a
phone's its plus sign, an email's the strict pattern after undoing the writing. For secrets
there are two models: an opaque run's format learns from whether it is assigned to a telling
name, an assigned value's context from whether its format is opaque. Labels come from the
proposals that are a base span or touch none, so what can be added isn't excluded from the
positives. A proposal that fails a check stands for as many as pass it by chance (a ninth for
Luhn's), so the trees tell the share of true ones among those that pass. Half of the documents
fit the trees, the other half calibrate the threshold at which `precision` is reached.

Proposals above their threshold that overlap no base span are added, the most likely one where
they overlap (then the longest, then the first); cards and ips must pass their checks too.

Positions are code points, ends exclusive. They come from the lengths of the matches and of
the pieces between them, as regular expressions split the text. The patterns are possessive
and start at the ends of runs, so that texts of any length take linear time and no stack.

Null text counts as empty: no spans. Repeated rows are treated alike; rows of null id are
kept. Extra columns are kept; those named like the new ones are replaced. A generator without
proposals in both halves has no model and adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.llm.boosting import Boosted, Cell, boost
from cellmend.llm.common import checkpointed, col, others

#: The base kinds in their order and their patterns, as the text above says.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: All kinds of spans, and the models, each with the kind that it adds.
ALL_KINDS = (*KINDS, "secret")
MODELS = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "opaque": "secret", "assigned": "secret"}
#: Names whose values are secrets, and what stands between a name and its value.
_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|auth|bearer|credentials?)"
_ASSIGNS = r"[\x22']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\x22']?"
_PART = r"[^\s@<>()\[\],;:\x22']"
_AT, _DOT = r"\s?[\[(]\s?[aA][tT]\s?[\])]\s?", r"\s?[\[(]\s?[dD][oO][tT]\s?[\])]\s?"
#: What the generators propose from: runs of digit groups, addresses, opaque runs, assignments.
RUNS = {
    "number": r"[0-9](?:[\x20().-]{0,2}+[0-9])++",
    "address": rf"(?:(?<!{_PART})|\G){_PART}++(?:@|\x20@\x20|{_AT}){_PART}++(?:{_DOT}{_PART}++)*+",
    "opaque": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}+",
    "assigned": rf"(?i)(?<![A-Za-z]){_NAMES}{_ASSIGNS}[^\s\x22',;]{{6,}}+",
}
#: A text without a match of this has none of the kind or generator.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "address": f"@|{_AT}", "opaque": "[A-Za-z0-9+/_-]{16}", "assigned": rf"(?i){_NAMES}{_ASSIGNS}"}
#: Words that often stand before personal data.
CUES = r"(?i)(?:\b(?:tel|phone|call|fax|mobile|card|mail|email|contact|ip|at|to)\b[^A-Za-z]{0,3})$"
CONTEXT_CHARS = 32
#: Digit groups of a window at most: a card has five, a phone seven.
GROUPS = 7
#: Numbers that are summed one by one.
BLOCK = 256
#: How many that pass a check by chance stand for one that fails it.
BY_CHANCE = {"card": 1 / 9}
PRECISION = 0.8


def _ends(sizes: Column) -> Column:
    """The running sums of an array of integers, by blocks, as arrays only grow by being copied."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    none, add = F.expr("cast(array() as array<int>)"), lambda a, x: a + x
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    heads = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + F.aggregate(x, F.lit(0), add)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    sums = lambda x: F.aggregate(x["block"], F.struct(x["head"].alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))["out"]
    return F.when(F.size(sizes) > 0, F.flatten(F.transform(F.zip_with(blocks, heads, lambda x, h: F.struct(x.alias("block"), h.alias("head"))), sums))).otherwise(none)


def _located(matches: str, gaps: str, ends: str) -> Column:
    """array<struct<s, e, m, before, after>> of the matches, the pieces between them, and their ends."""
    g, e = F.col(gaps), F.col(ends)
    return F.transform(F.col(matches), lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("m"), F.right(F.get(g, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's check."""
    d = _digits(m)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.when(F.length(d).between(14, 19), F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


#: The checks of the base kinds.
CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _count(m: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(m, pattern, ""))


def _bucket(x: Column, *bounds: int) -> Column:
    """How many of the bounds x reaches."""
    return reduce(lambda a, b: a + b, [(x >= b).cast("int") for b in bounds])


def _context(before: Column, after: Column) -> list[Column]:
    last = F.right(before, F.lit(1))
    return [
        F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"[\x22'=:]"), 2).when(last.rlike(r"[\p{L}_]"), 3).otherwise(4),
        F.when(after == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(3),
        F.rtrim(before).rlike(CUES).cast("int"),
    ]


def _proposal(model: str, s: Column, e: Column, passes: Column, features: list[Column]) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(list(MODELS).index(model)).alias("model"), F.coalesce(passes, F.lit(False)).alias("passes"), F.array(*(f.cast("int") for f in features)).alias("x"))


_NO_PROPOSALS = "cast(array() as array<struct<s: int, e: int, model: int, passes: boolean, x: array<int>>>)"


def _windows(runs: Column) -> Column:
    """The proposals of runs of digit groups."""
    cut = F.transform(runs, lambda r: F.struct(r.alias("run"), F.regexp_extract_all(r["m"], F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.split(r["m"], "[0-9]+", -1).alias("gaps")))
    placed = F.transform(cut, lambda c: F.struct(c["run"].alias("run"), c["groups"].alias("groups"), c["gaps"].alias("gaps"), _ends(F.transform(c["groups"], lambda x, i: F.length(x) + F.length(F.get(c["gaps"], i)))).alias("ends")))

    def spread(c: Column) -> Column:
        """Places of the first and the last group, and the window's own place in the run."""
        all_ = F.transform(c["ends"], lambda e, i: F.transform(F.slice(c["ends"], i + 1, F.lit(GROUPS)), lambda x, n: F.struct(i.alias("i"), (i + n).alias("j"), (e - F.length(F.get(c["groups"], i))).alias("s"), x.alias("e"))))
        return F.filter(F.flatten(all_), lambda w: (w["e"] - w["s"]).between(7, 33))

    def told(c: Column, w: Column) -> Column:
        """A window with its text and what is around it, from the groups and gaps next to it."""
        group, gap, i, j = lambda k: F.get(c["groups"], k), lambda k: F.get(c["gaps"], k), w["i"], w["j"]
        text = F.array_join(F.transform(F.sequence(i, j), lambda k: F.concat(F.when(k > i, gap(k)).otherwise(F.lit("")), group(k))), "")
        first, last = i == 0, j == F.size(c["groups"]) - 1
        return F.struct(
            (j - i + 1).alias("n"), F.length(group(i)).alias("first"), F.length(group(j)).alias("last"), (w["s"] + c["run"]["s"]).alias("s"), (w["e"] + c["run"]["s"]).alias("e"), text.alias("m"),
            F.when(first, c["run"]["before"]).otherwise(F.right(F.concat(group(i - 1), gap(i)), F.lit(CONTEXT_CHARS))).alias("before"),
            F.when(last, c["run"]["after"]).otherwise(F.left(gap(j + 1), F.lit(1))).alias("after"),
        )

    windows = F.flatten(F.transform(placed, lambda c: F.transform(spread(c), lambda w: told(c, w))))

    def proposed(w: Column) -> Column:
        size = F.length(_digits(w["m"]))
        plus = F.right(w["before"], F.lit(1)) == "+"
        lead_in = F.when(plus, 1).when((F.right(w["before"], F.lit(1)) == "(") & w["m"].contains(")"), 1).otherwise(0)
        format_ = [_bucket(size, 10, 11, 12, 13, 14, 15, 16, 17), _bucket(w["n"], 2, 3, 4, 5), _bucket(w["first"], 2, 3, 4, 5), _bucket(w["last"], 3, 4, 5), w["m"].contains(".").cast("int"), w["m"].contains("-").cast("int"), w["m"].rlike(r"[()]").cast("int"), w["m"].contains(" ").cast("int")]
        features = [*format_, *_context(F.when(plus, F.left(w["before"], F.length(w["before"]) - 1)).otherwise(w["before"]), w["after"])]
        is_ip = w["m"].rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
        is_card = ~plus & size.between(14, 19) & w["m"].rlike(r"^[0-9](?:[\x20-]?[0-9])+$")
        is_phone = size.between(10, 15) & (plus | (w["n"] > 1))
        return (
            F.when(is_ip, _proposal("ip", w["s"], w["e"], CHECKS["ip"](w["m"]), features))
            .when(is_card, _proposal("card", w["s"], w["e"], _luhn(w["m"]), features))
            .when(is_phone, _proposal("phone", w["s"] - lead_in, w["e"], plus, features))
        )

    return F.filter(F.transform(windows, proposed), lambda p: p.isNotNull())


def _address(x: Column) -> Column:
    m = F.regexp_replace(x["m"], r"[.!?]+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, _AT, "@"), _DOT, "."), r"\s", "")
    local, domain = F.substring_index(plain, "@", 1), F.substring_index(plain, "@", -1)
    format_ = [_bucket(F.length(local), 2, 5, 20, 65), _bucket(_count(domain, r"[^.]"), 1, 2, 3), _bucket(F.length(domain), 4, 10, 40), domain.rlike(r"[A-Za-z]$").cast("int"), local.rlike(r"^[A-Za-z0-9]").cast("int"), (plain != m).cast("int")]
    passes = plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$") & ((plain == m) | plain.rlike(r"\.[A-Za-z]{2,}$"))
    return _proposal("email", x["s"], x["s"] + F.length(m), passes, [*format_, *_context(x["before"], x["after"])])


def _is_opaque(m: Column) -> Column:
    """Whether a value looks drawn at random: long, of letters and digits, of many kinds."""
    return (F.length(m) >= 16) & m.rlike("[A-Za-z]") & m.rlike("[0-9]") & (F.size(F.array_distinct(F.split(m, ""))) >= 9)


def _opaque(x: Column) -> Column:
    m = x["m"]
    size = F.length(m)
    charset = F.when(m.rlike("^[0-9a-f]+$") | m.rlike("^[0-9A-F]+$"), 0).when(m.rlike("^[A-Za-z0-9]+$"), 1).otherwise(2)
    kinds = m.rlike("[a-z]").cast("int") + 2 * m.rlike("[A-Z]").cast("int") + 4 * m.rlike("[0-9]").cast("int")
    digits = F.floor(F.length(_digits(m)) * 5 / size)
    passes = x["before"].rlike(rf"(?i){_NAMES}{_ASSIGNS}$")
    return _proposal("opaque", x["s"], x["e"], passes, [charset, kinds, _bucket(size, 20, 24, 28, 32, 33, 40, 41, 64, 65), _bucket(F.size(F.array_distinct(F.split(m, ""))), 6, 9, 12, 20), digits])


def _assigned(x: Column) -> Column:
    value = F.regexp_extract(x["m"], r"([^\s\x22',;]+)$", 1)
    name, signs = F.lower(F.regexp_extract(x["m"], "^[A-Za-z_-]+", 0)), F.left(x["m"], F.length(x["m"]) - F.length(value))
    which = F.when(name.contains("pass") | (name == "pwd"), 0).when(name.contains("key"), 1).when(name.contains("secret"), 2).when(name == "token", 3).otherwise(4)
    sign = F.when(signs.contains("=>") | signs.contains(":="), 0).when(signs.contains("="), 1).otherwise(2)
    return _proposal("assigned", x["e"] - F.length(value), x["e"], _is_opaque(value), [which, sign, signs.rlike(r"[\x22']$").cast("int"), signs.rlike(r"\s").cast("int"), *_context(x["before"], x["after"])[:2]])


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def found_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base array<struct<s, k, e>>, proposed array<struct<s, e, model, passes, free, x>>), written
    down: a row for each of df's, in which the text is read once. Proposals that only touch a base
    span are left out; free ones overlap none, the others are one."""
    text = F.col("text")
    patterns = {**BASE, **RUNS}
    out = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    out = out.select("id", *(F.when(text.rlike(NEEDED[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()), "text")
    out = out.select("id", *(f"m_{k}" for k in patterns), *(F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"g_{k}") for k, p in patterns.items()))
    sizes = lambda k: F.transform(f"m_{k}", lambda m, i: F.length(m) + F.length(F.get(F.col(f"g_{k}"), i)))
    out = out.select("id", *(f"{x}_{k}" for x in "mg" for k in patterns), *(_ends(sizes(k)).alias(f"e_{k}") for k in patterns))
    out = out.select("id", *(_located(f"m_{k}", f"g_{k}", f"e_{k}").alias(k) for k in patterns))

    def checked(number: int, kind: str) -> Column:
        return F.transform(F.filter(F.col(kind), lambda x: CHECKS[kind](x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e")))

    base = F.array_sort(F.concat(*(checked(i, k) for i, k in enumerate(KINDS))))
    long_runs = F.filter(F.col("number"), lambda x: x["e"] - x["s"] >= 7)
    secrets = F.filter(F.col("opaque"), lambda x: x["m"].rlike("[A-Za-z]"))
    out = out.select("id", base.alias("base"), F.concat(F.expr(_NO_PROPOSALS), _windows(long_runs), F.transform(F.col("address"), _address), F.transform(secrets, _opaque), F.transform(F.col("assigned"), _assigned)).alias("proposed"))
    kind_of = F.array(*(F.lit(ALL_KINDS.index(k)) for k in MODELS.values()))
    is_base = lambda p: F.exists("base", lambda b: (b["s"] == p["s"]) & (b["e"] == p["e"]) & (b["k"] == F.get(kind_of, p["model"])))
    told = F.transform("proposed", lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), p["model"].alias("model"), p["passes"].alias("passes"), (~_overlaps(p, F.col("base"))).alias("free"), is_base(p).alias("known"), p["x"].alias("x")))
    return checkpointed(out.select("id", "base", F.filter(told, lambda p: p["free"] | p["known"]).alias("proposed")))


def fit(found: DataFrame, precision: float = PRECISION) -> dict[str, Boosted]:
    """The trees of the models, from counts of all proposals' feature vectors."""
    rows = found.select((F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("fits"), F.explode("proposed").alias("p")).groupBy("fits", "p.model", "p.x").agg(F.count("*").alias("n"), F.sum(F.col("p.passes").cast("long")).alias("passed"))
    cells: dict[tuple[str, bool], list[Cell]] = {}
    for r in rows.collect():  # bounded by the features' ranges
        name = list(MODELS)[r["model"]]
        cells.setdefault((name, r["fits"]), []).append(Cell(tuple(r["x"]), r["passed"] + BY_CHANCE.get(name, 1.0) * (r["n"] - r["passed"]), r["passed"]))
    models = {}
    for name in MODELS:
        own, held = (sorted(cells.get((name, fits), []), key=lambda c: c.features) for fits in (True, False))
        model = boost(own)
        if model is not None:
            model.calibrate(held, precision)
            models[name] = model
    return models


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(id, base, added): arrays of structs of start, kind's number (in ALL_KINDS) and end, by start."""
    found = found_spans(df, id_col, text_col)
    models = {n: m for n, m in fit(found, precision).items() if m.threshold < float("inf")}
    nothing = F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)")
    if not models:
        return found.select(F.col("id").alias(id_col), "base", nothing.alias("added"))
    number = {n: i for i, n in enumerate(MODELS)}

    def by_model(p: Column, value) -> Column:
        out = F.lit(None).cast("double")
        for n, m in models.items():
            out = F.when(p["model"] == number[n], value(n, m, p)).otherwise(out)
        return out

    margin = lambda p: by_model(p, lambda n, m, p: m.sql(lambda k: F.get(p["x"], F.lit(k))) - F.lit(m.threshold - 1e-9))
    must_pass = [number["ip"], number["card"]]
    kind_of = F.array(*(F.lit(ALL_KINDS.index(k)) for k in MODELS.values()))
    scored = F.transform(F.filter("proposed", lambda p: p["free"] & (p["passes"] | ~p["model"].isin(must_pass))), lambda p: F.struct(margin(p).alias("score"), (p["s"] - p["e"]).alias("size"), p["s"].alias("s"), F.get(kind_of, p["model"]).alias("k"), p["e"].alias("e")))
    ranked = F.array_sort(F.transform(F.filter(scored, lambda p: p["score"] >= 0), lambda p: p.withField("score", -F.round(p["score"], 6))))
    take = lambda kept, p: F.when(_overlaps(p, kept), kept).otherwise(F.concat(kept, F.array(F.struct(p["s"].alias("s"), p["k"].alias("k"), p["e"].alias("e")))))
    return found.select(F.col("id").alias(id_col), "base", F.array_sort(F.aggregate(ranked, nothing, take)).alias("added"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == ALL_KINDS.index(kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "redacted", precision: float = PRECISION) -> DataFrame:
    """df with its texts in which each span (of overlapping ones, the first) is replaced by its
    kind in brackets. Ids are unique."""
    found = find_pii(df, id_col, text_col, precision).select(F.col(id_col).alias("__id"), F.array_sort(F.concat("base", "added")).alias("__spans"))
    names = F.array(*map(F.lit, ALL_KINDS))
    text = F.coalesce(col(text_col), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), new.alias("out"))).otherwise(acc)

    kept = others(df, out_col)
    with_spans = df.join(found, col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("__done", F.aggregate(F.col("__spans"), zero, step))
    return with_spans.select(*(col(c) for c in kept), F.concat("__done.out", F.substring(text, F.col("__done.at") + 1, F.length(text))).alias(out_col))
