"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

DataFrame functions only. Base patterns for e-mail addresses, IP addresses, card and phone numbers are always spans.
Wider generators (spelled-out and bracketed separators, numbers without a plus sign, other groupings, and strings that may
be keys or passwords) propose more; each proposal gets features of its format and its context, an ensemble of boosted trees, written out as CASE
expressions, scores it, and it becomes a span above its kind's threshold if no base span overlaps it. The trees are
trained on generated sentences with the very features computed here. Thresholds are set for a precision of PRECISION on
sentences of another family, whose words, cues and separators the trees have not seen.

All array work takes about n ** 1.5 steps for n matches, by prefix sums over blocks of the square root of n.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans: the base kinds, and those that only the method adds.
ALL = (*KINDS, "secret")
TREES = 24
DEPTH = 2
LEARNING = 0.4
EXAMPLES = 4000
PRECISION = 0.98
#: Code points that stand for a separator between two digits, and for a dot between two name characters, while
#: matching; what a text has of them counts as a letter. So patterns need no group under a quantifier, which Java
#: would match recursively, and matches of any length are safe.
_SEP, _DOT = "\x01", "\x02"

_LOCAL = rf"[A-Za-z0-9._%+{_DOT}-]"
#: Pattern over the marked text by kind. `\G` lets a match start where the last one ended.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+{_DOT}[A-Za-z0-9{_DOT}-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{_SEP}])(?:[0-9]{_SEP}?){{12,19}}(?![0-9{_SEP}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider proposals, over the text itself.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\{at\}|<at>|\sat\s)\s?[a-z0-9-]++\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[a-z]{2,}+\b",
    "ip": r"(?i)\b(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}|[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4})\b",
    "card": r"(?<![0-9a-fA-F])[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{4}(?:[./_]|\x20\x20|\x20-\x20)[0-9]{3,4}(?![0-9a-fA-F])",
    "phone": r"(?<![0-9A-Za-z+.:/-])(?:\([0-9]{2,4}\)[ .-]?|00[0-9]{1,3}[ .-])?[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z:/-])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
#: Cheap conditions that hold wherever a pattern can match.
_GATE = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][0-9 -]{11}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
_WIDE_GATE = {
    "email": lambda t: t.rlike(r"(?i)[(\[{<\s]at[)\]}>\s]"),
    "ip": lambda t: t.rlike(r"(?i)[0-9][(\[](?:\.|dot)[)\]][0-9]|[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9]{4}[./_ -]{1,3}[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9][ .)-]{1,2}[0-9]"),
    "secret": lambda t: t.rlike(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16}"),
}
#: Words that announce a kind of data, in the four languages.
_CONTEXT = {
    "email": r"(?i)mail|contact|write|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|addr|adresse",
    "card": r"(?i)card|visa|master|credit|tarjeta|carte|karte|\bpan\b",
    "phone": r"(?i)phone|\btel|call|fax|mobile|cell|handy|anruf|appel|llam|\bnum[bé]",
    "secret": r"(?i)key|token|secret|passw|\bpwd|credential|\bauth|contrase|geheim|schl[uü]ssel|\bclave|mot de passe",
}
FEATURES = ("digits", "letters", "length", "separators", "luhn", "small_parts", "context", "other_context", "inside_code", "inside_word", "paren", "groups", "brackets", "spelled_dot", "hex", "cases", "assigned", "quoted")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, merge) -> Column:
    """Running results of an associative merge over an array, by blocks of the square root of its size."""

    def plain(xs: Column) -> Column:
        first = F.array(F.element_at(xs, 1))
        return F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), first, lambda acc, x: F.array_append(acc, merge(F.element_at(acc, -1), x)))

    def blocks(xs: Column) -> Column:
        n = F.size(xs)
        width = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
        return F.transform(starts, lambda i: plain(F.slice(xs, i * width + 1, width)))

    def joined(inner: Column) -> Column:
        ends = plain(F.transform(inner, lambda b: F.element_at(b, -1)))
        return _let(ends, lambda e: F.flatten(F.transform(inner, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: merge(F.element_at(e, i), v))))))

    return _let(values, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(_let(blocks(xs), joined)))


_FOUND = "array<struct<start: int, end: int, found: string>>"


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches, in code points: running sums over pieces and matches."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(z: Column) -> Column:
        ends = _scan(F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b)
        return F.filter(F.zip_with(z, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("found"))), lambda s: s["found"].isNotNull())

    return F.when(F.size(zipped) > 1, _let(zipped, spans)).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def _wide(text: Column) -> Column:
    """The text with four bytes for each code point, so that a slice takes no search from its start."""
    return F.encode(text, "UTF-32")


def _slice(wide: Column, start: Column, size: Column) -> Column:
    return F.decode(F.substring(wide, start * 4 + 1, size * 4), "UTF-32")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ds = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(9)) + F.when(c == "9", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_parts(x: Column, separator: str = r"\.") -> Column:
    """Whether all parts of dotted digits are at most 255."""

    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(x, separator), small)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind array<struct<start, end, found>> of the base matches that hold."""
    marked_digits = F.regexp_replace(F.translate(text, _SEP, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    marked_names = F.regexp_replace(F.translate(text, _DOT, "\x03"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    source = {"email": marked_names, "ip": text, "card": marked_digits, "phone": text}
    holds = {
        "email": None,
        "ip": lambda s: _small_parts(s["found"]),
        "card": lambda s: _luhn(_digits(s["found"])),
        "phone": lambda s: F.length(_digits(s["found"])).between(9, 15),
    }
    none = F.expr(f"cast(array() as {_FOUND})")
    out = {}
    for k in KINDS:
        found = _located(source[k], BASE[k])
        out[k] = F.when(_GATE[k](text), F.filter(found, holds[k]) if holds[k] else found).otherwise(none)
    return out


def _features(kind: str, s: Column, wide: Column) -> Column:
    """The proposal s with its FEATURES, all ints; wide is the text as _wide() has it."""
    found = s["found"]
    digits = _digits(found)
    before = _slice(wide, F.greatest(s["start"] - 24, F.lit(0)), F.least(s["start"], F.lit(24)))
    after = _slice(wide, s["end"], F.lit(4))
    other = "|".join(x.removeprefix("(?i)") for k, x in _CONTEXT.items() if k != kind)
    values = {
        "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(found, "[^A-Za-z]", "")),
        "length": F.length(found),
        "separators": F.length(F.regexp_replace(found, "[0-9A-Za-z]", "")),
        "luhn": _luhn(digits).cast("int"),
        "small_parts": _small_parts(F.regexp_replace(found, r"[\[(](?:\.|(?i)dot)[\])]", "."), "[^0-9]+").cast("int"),
        "context": before.rlike(_CONTEXT[kind]).cast("int"),
        "other_context": before.rlike(f"(?i){other}").cast("int"),
        "inside_code": (before.rlike(r"[=\"'#/_]\s*\S*$") | after.rlike(r"^\S*[\"'/_=]")).cast("int"),
        "inside_word": (before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")).cast("int"),
        "paren": found.startswith("(").cast("int"),
        "brackets": F.length(F.regexp_replace(found, r"[^\[({<]", "")),
        "spelled_dot": found.rlike(r"(?i)[\[({\s]dot[\])}\s]").cast("int"),
        "hex": found.rlike("^[0-9a-fA-F]+$").cast("int"),
        "cases": (found.rlike("[a-z]") & found.rlike("[A-Z]")).cast("int"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"),
        "quoted": before.rlike(r"[\"'`]$").cast("int"),
        "groups": F.size(F.filter(F.split(found, "[^0-9]+"), lambda g: g != "")),
    }
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), found.alias("found"), *(F.coalesce(values[x], F.lit(0)).cast("int").alias(x) for x in FEATURES))


def proposals(text: Column, kind: str) -> Column:
    """array<struct<start, end, found, FEATURES...>> of the wide generator of a kind."""
    return _let(F.struct(_located(text, WIDE[kind]).alias("at"), _wide(text).alias("wide")), lambda x: F.transform(x["at"], lambda s: _features(kind, s, x["wide"])))


# ---------------------------------------------------------------- training


#: Parts of the generated sentences by family: trees learn from the first, thresholds are set on the second.
_FAMILIES = (
    {
        "syllables": ("th", "er", "on", "an", "re", "in", "ed", "nd", "ou", "la", "de", "sch"),
        "email": ("mail ", "contact: ", "write to ", ""), "ip": ("ip ", "host ", "server ", ""), "card": ("card ", "visa ", "credit card: ", ""), "phone": ("phone ", "tel. ", "call ", "phone: ", ""),
        "secret": ("token = \"", "api_key: ", "password=", "secret: '"),
        "other": ("year ", "page ", "score ", "ref ", "", "", "id "),
        "at": ((" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" at ", " dot ")), "dots": ("[.]", "[dot]"), "gaps": (".", "/", " - "),
        "phones": ("(3) 3-4", "3-3-4", "00;2 3 3 4"), "others": ("2.2", "4-2-2", "4-4", "2 3", "3-2-4", "4 4 4", "4-4-4"),
    },
    {
        "syllables": ("ka", "lo", "mi", "stra", "ber", "que", "ion", "ta", "fel", "us", "wo"),
        "email": ("e-mail: ", "courriel ", "kontakt ", "reach me: ", ""), "ip": ("address ", "from host ", "addr=", ""), "card": ("tarjeta ", "mastercard: ", "karte ", ""), "phone": ("fax: ", "mobile ", "handy ", "my number: ", ""),
        "secret": ("secret_key=\"", "auth token: ", "pwd: ", "key='"),
        "other": ("seite ", "total ", "no. ", "", "", "version ", "ratio "),
        "at": (("{at}", "."), ("<at>", "(dot)"), (" [at] ", "."), (" at ", " dot ")), "dots": ("(.)", "[.]"), "gaps": ("_", "  ", "."),
        "phones": ("(3)3.4", "3.3.4", "(2) 4-4", "00;3 2 3 3"), "others": ("3.2", "2-2-4", "4 4 4", "3 3", "2.4", "4-3"),
    },
)


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, int, int]]:
    """Generated sentences (kind, text, label, family) with about one proposal each; bounded by n.

    Cues and formats do not settle the label: data stands without a cue, and what looks like data stands behind one.
    """
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    shape = lambda form: "".join(num(int(c)) if c.isdigit() and c != "0" else c for c in form.replace("00;", "\0")).replace("\0", "00")

    def luhn(body: str) -> str:
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def sample(kind: str, label: int, f: dict) -> tuple[str, str]:
        word = lambda: "".join(rng.choice(f["syllables"]) for _ in range(rng.randint(1, 4)))
        cue = rng.choice(f[kind]) if rng.random() < (0.8 if label else 0.1) else rng.choice(f["other"])
        if kind == "email":
            if label:
                at, dot = rng.choice(f["at"])
                return cue, f"{word()}{rng.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
            return cue, f"{word()}{rng.choice((' at ', '. At ', ', at '))}{word()}{rng.choice(('. ', '.', ' . '))}{word()}"
        if kind == "ip":
            s = rng.choice(f["dots"])
            return cue, s.join(str(rng.randint(1, 255)) for _ in range(4)) if label else rng.choice((":".join(num(2) for _ in range(8)), s.join(num(3) for _ in range(3)) + s + str(rng.randint(300, 999))))
        if kind == "card":
            body = luhn(rng.choice("3456") + num(14))
            if not label:
                body = body[:15] + str((int(body[15]) + rng.randint(1, 9)) % 10)
            return cue, rng.choice(f["gaps"]).join(body[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            return cue, shape(rng.choice(f["phones"] if label else f["others"]))
        mixed = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(rng.randint(16, 44)))
        code = mixed if rng.random() < 0.5 else "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64))))
        if label:
            return rng.choice(f["secret"]), code
        return cue if cue in f["other"] else rng.choice(f["other"]), rng.choice((code, f"{word()}{word()}{word()}{num(3)}{word()}{word()}", f"{word()}-{num(4)}-{word()}-{num(2)}-{word()}"))

    out = []
    for i in range(n):
        kind, label, family = ALL[i % len(ALL)], rng.randint(0, 1), i // len(ALL) % 2
        lead, span = sample(kind, label, _FAMILIES[family])
        word = rng.choice(_FAMILIES[family]["syllables"])
        out.append((kind, f"{word}{word} {lead}{span}{lead[-1] if lead[-1:] in ('\"', chr(39)) else ''} {word} {word}.", label, family))
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list]:
    """Gradient boosting of trees of DEPTH 2 on the logistic loss, with Newton leaves. A tree: (feature, cut, left, right) or a leaf value."""
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, out = np.full(len(y), start), []
    values, place = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        all_g, all_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth else ():
            # Sums up to each value of the feature: one cut after each value but the last.
            of = lambda w, f=f: np.cumsum(np.bincount(place[f][rows], w, len(values[f])))[:-1]
            n, gl, hl = of(np.ones(len(rows))), of(g[rows]), of(h[rows])
            gain = gl**2 / (hl + 1.0) + (all_g - gl) ** 2 / (all_h - hl + 1.0) - all_g**2 / (all_h + 1.0)
            gain[(n < 1) | (n > len(rows) - 1)] = 0.0
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), (f, int(values[f][gain.argmax()])))
        if best[1] is None:
            return float(LEARNING * all_g / (all_h + 1.0))
        f, cut = best[1]
        left = x[rows, f] <= cut
        return f, cut, grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1)

    def value(tree, at: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(at), tree)
        f, cut, a, b = tree
        return np.where(at[:, f] <= cut, value(a, at), value(b, at))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH)
        out.append(tree)
        score = score + value(tree, x)
    return start, out


def score_of(model: tuple[float, list], row) -> Column:
    """The ensemble as a column of log odds; row gives the column of a feature's name."""

    def case(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, cut, a, b = tree
        return F.when(row(FEATURES[f]) <= cut, case(a)).otherwise(case(b))

    total = F.lit(model[0])
    for tree in model[1]:
        total = total + case(tree)
    return total


_MODELS: dict[str, tuple[tuple[float, list], float]] = {}


def models(spark: SparkSession) -> dict[str, tuple[tuple[float, list], float]]:
    """By kind the trees and the threshold; trained once in a driver process, always to the same result."""
    if not _MODELS:
        rows = spark.createDataFrame(examples(), "kind string, text string, label int, family int").coalesce(1)
        proposed = {k: F.when(F.col("kind") == k, proposals(F.col("text"), k)) for k in ALL}
        got = rows.select("kind", "label", "family", F.coalesce(*proposed.values()).alias("found")).collect()  # EXAMPLES rows at most
        for k in ALL:
            data = [([s[f] for f in FEATURES], r["label"], r["family"]) for r in got if r["kind"] == k for s in r["found"] or []]
            x, y, family = (np.array(v) for v in zip(*data))
            model = boost(x[family == 0], y[family == 0].astype(float))
            logit, truth = _apply(model, x[family == 1]), y[family == 1]
            best, cuts = np.inf, np.unique(logit)[::-1]
            for cut, lower in zip(cuts, [*cuts[1:], cuts[-1] - 1]):
                if truth[logit >= cut].mean() < PRECISION:
                    break
                best = float(cut + lower) / 2  # between two scores, so that rounding decides nothing
            _MODELS[k] = (model, max(best, 0.0))
    return _MODELS


def _apply(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def value(tree, at: np.ndarray) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if at[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([model[0] + sum(value(t, at) for t in model[1]) for at in x])


# ---------------------------------------------------------------- the operator


def _join(spans: Column) -> Column:
    """Spans as text, by start, then kind in the order of ALL, then end."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["no"], s["end"])))
    name = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with array columns of base spans and of all spans, struct<start, end, no> each; their names.

    Null texts are empty. Starts and ends count code points, ends are exclusive, no is the kind's place in ALL.
    """
    trained = models(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    base = fresh(docs.columns, "base_spans")
    every = fresh([*docs.columns, base], "all_spans")
    plain = lambda no: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(no).alias("no"))
    found = base_spans(body)
    out = docs.withColumn(base, F.concat(*(F.transform(found[k], plain(i)) for i, k in enumerate(KINDS))))
    none = F.expr("cast(array() as array<struct<start: int, end: int, no: int>>)")
    above = lambda model, threshold: lambda s: score_of(model, lambda f: s[f]) >= threshold
    extra = []
    for i, k in enumerate(ALL):
        good = F.filter(proposals(body, k), above(*trained[k]))
        extra.append(F.when(_WIDE_GATE[k](body), F.transform(good, plain(i))).otherwise(none))
    out = out.withColumn(every, F.concat(*extra))
    # A wide span is free if no base span that starts before its end reaches over its start: running maxima over all ends and starts in order.
    event = lambda at, is_base, value, no: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"), value.alias("value"), no.alias("no"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 1, b["end"], b["no"])), F.transform(every, lambda s: event(s["end"], 0, s["start"], s["no"]))))

    def free(es: Column) -> Column:
        reach = _scan(F.transform(es, lambda e: F.when(e["is_base"] == 1, e["value"]).otherwise(F.lit(-1))), F.greatest)
        kept = F.filter(F.zip_with(es, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda x: (x["e"]["is_base"] == 0) & (x["r"] <= x["e"]["value"]))
        return F.transform(kept, lambda x: F.struct(x["e"]["value"].alias("start"), x["e"]["at"].alias("end"), x["e"]["no"].alias("no")))

    added = F.when(F.size(every) == 0, none).when(F.size(base) == 0, F.col(every)).otherwise(_let(events, free))
    return out.withColumn(every, F.concat(F.col(base), added)), base, every


def pii(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and their number, those that the method adds included.

    Null and empty texts have no spans; very long texts and any number of matches are searched whole. Null and repeated
    ids stay, and repeated rows are alike. Spans of one start go by kind, then end. Extra columns are dropped, whatever
    their names. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    out, base, every = with_spans(plain, "text")
    of_kind = lambda i: lambda s: s["no"] == i
    counts = [F.size(F.filter(F.col(base), of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.encode(_join(F.col(base)), "UTF-8"), 256).alias("base_sha256"), _join(F.col(every)).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one, named for the first.

    A null text stays null, an empty one empty. The column named by length, if there is one, gets the new number of code
    points where spans were found. Very long texts are redacted whole; null ids, repeated rows and columns of any name
    stay as they are. An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    body = names[docs.columns.index(text)]
    out, _, every = with_spans(plain, body)
    ordered = F.array_sort(F.transform(F.col(every), lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"))))
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))

    def clean(x: Column) -> Column:
        # Up to where the spans before each one reach; a span that starts short of that is part of another.
        reach = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(x["reach"], i))
        heads = F.filter(F.transform(x["spans"], lambda s, i: F.struct(s.alias("s"), reach(i).alias("at"))), lambda h: h["s"]["start"] >= h["at"])
        parts = F.transform(heads, lambda h: F.concat(_slice(x["wide"], h["at"], h["s"]["start"] - h["at"]), F.element_at(tag, h["s"]["no"] + 1)))
        last = F.element_at(x["reach"], -1)
        return F.concat(F.array_join(parts, ""), _slice(x["wide"], last, x["size"] - last))

    packed = lambda o: F.struct(o.alias("spans"), _scan(F.transform(o, lambda s: s["end"]), F.greatest).alias("reach"), _wide(F.col(body)).alias("wide"), F.length(body).alias("size"))
    out = out.withColumn(body, F.when(F.size(every) > 0, _let(_let(ordered, packed), clean)).otherwise(F.col(body)))
    if length in docs.columns:
        n = names[docs.columns.index(length)]
        out = out.withColumn(n, F.when(F.size(every) > 0, F.length(body).cast("long")).otherwise(F.col(n)))
    return out.select(*names).toDF(*docs.columns)


def query(spark, sf_dir):
    """op4: whole `documents`."""
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
