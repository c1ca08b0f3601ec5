"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from the base patterns (also matches that fail a base check) and from wider ones. Labelers (form, check,
gazetteer, supporting and opposing context) vote on every candidate; expectation-maximisation over the counted vote
patterns estimates how far each labeler can be relied on; the posteriors train a naive Bayes span classifier over votes,
shape and neighbouring words, which decides on all spans but the base ones. Base spans stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "person", "address")
# Fixed: the base patterns, with possessive loops of single characters, so that runs of any length match in one pass.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?=[A-Za-z0-9-]|\.[A-Za-z0-9-])[A-Za-z0-9.-])++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:(?=[0-9]|[\x20-][0-9])[0-9\x20-]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider patterns, with the kind under which a span is reported and what a text must hold for them.
_WIDE = (
    ("email", r"(?<![\w.@])[A-Za-z0-9._%+-]{2,64}+(?: ?[\[({](?:at|AT|@)[\])}] ?| at | @ )[A-Za-z0-9-]{2,64}+(?: ?[\[({](?:dot|DOT|\.)[\])}] ?| dot |\.)[A-Za-z]{2,12}(?![\w@])",
     r"[\[({](?:at|AT|@)[\])}]| at | @ "),
    ("phone", r"(?<![\w+.-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])", "[0-9]{4}"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", "-[0-9]{2}-"),
    ("person", r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora|Señor|Monsieur|Madame)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})?", "M|Dr|Prof|Herr|Frau|Señor"),
    ("address", r"(?<![\w.,-])[0-9]{1,5},? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|Square|Court|Straße|Strasse|Weg|Platz)\b", "[0-9],? \\p{Lu}"),
)
# Labelers that read the span: by kind, what speaks for it and what against it ("" never does).
_FORM = {
    "email": (r"[@\[({]| dot ", r" at [^ ]+\.[^ ]+$"),
    "ip": (r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$", r"(?:^|\.)0[0-9]|[0-9]{4}"),
    "card": (r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$", r"^[0-9]{1,2}[ -]|[ -][0-9][ -]|[0-9]{20}"),
    "phone": (r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){0,3}$", r"\.\.|--|\(\(|\)\)|  "),
    "ssn": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", ""),
    "person": (r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", r"\p{Lu}{3}"),
    "address": (r"(?:Street|Avenue|Road|Lane|Boulevard|Drive|Square|Court|Straße|Strasse|Platz)$", r"\p{Lu}{3}"),
}
# Gazetteers: top-level domains, networks that are no host's, issuer prefixes, country and area codes, names.
_GAZETTEER = {
    "email": (r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|ai|co|de|at|ch|fr|be|nl|es|pt|it|uk|ie|us|ca|mx|br|ar|au|nz|in|cn|jp|kr|ru|pl|cz|se|no|dk|fi|gr|tr|za|eu)$", r"(?i)(?:exe|txt|pdf|jpg|png|html?|php|the|and)$"),
    "ip": ("", r"^(?:0|127|22[4-9]|2[3-5][0-9]|[3-9][0-9]{2})\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))", r"^[01789]"),
    "phone": (r"^\+?\(?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ (.0-9-]|^\(?[2-9][0-9]{2}\)?[ .-][2-9]", r"^\+0|^\(?[01][0-9]{2}\)?[ .-]"),
    "ssn": (r"^(?:00[1-9]|0[1-9][0-9]|[1-6][0-9]{2}|7[0-6][0-9]|77[0-2])", r"^(?:000|666|9)|-00-|-0000$"),
    "person": (
        r"\b(?:John|Mary|James|Anna|Peter|Maria|Paul|Laura|Jean|Marie|Carlos|Carmen|Hans|Greta|Robert|Linda|Michael|Susan|David|Karen|Thomas|Sarah|Daniel|Emma|Pierre|Claire|Luis|Lucía|"
        r"José|Ana|Juan|Sofía|Karl|Heidi|Klaus|Ingrid|Smith|Johnson|Brown|Miller|Jones|Müller|Schmidt|Schneider|Fischer|Weber|Martin|Bernard|Dubois|Durand|Moreau|García|Martínez|López|Sánchez|Pérez)\b", ""),
    "address": (r"\b(?:Main|High|Church|Park|Oak|Elm|Maple|Station|Market|King|Queen|Bahnhof|Haupt|Garten)", ""),
}
_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|reply|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|client|login|connected)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|pay|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|ring|telefon|teléfono|téléphone)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|taxpayer|sozial|seguridad)\b",
    "person": r"(?i)\b(?:name|dear|by|from|signed|with|contact|sincerely|patient|client)\b",
    "address": r"(?i)\b(?:address|lives?|located|at|ship|deliver|home|visit|adresse|dirección)\b",
}
_AGAINST = r"(?i)\b(?:version|isbn|order|invoice|ref|part|page|figure|table|total|chapter|section|serial|sku|build|release|item|code|number)\b"
_LABELERS = ("form", "check", "gazetteer", "support", "oppose")
_FEATURES = ("f_length", "f_shape", "f_left", "f_right")
_BLOCK = 128


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: acc + _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1),
    )
    return total % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)


def _valid(kind: str, value: Column) -> Column:
    """Whether a match passes the check of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "ssn":
        return ~value.rlike(_GAZETTEER["ssn"][1])
    return F.lit(True)


def _plausible(kind: str, value: Column) -> Column:
    """Which matches that fail a base check are still worth a vote; at the bounds, a digit more or less than allowed."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {"card": n.between(13, 20), "phone": n.between(7, 16), "ip": F.length(value) <= 19}.get(kind, F.lit(True))


def _running(values: Column, zero: Column, merge) -> Column:
    """What ``merge`` makes of all earlier values, for each value: inside blocks and over blocks, so nearly linear.

    ``values`` must be a column of its own (it is named twice and not to be made anew for each block).
    """
    last = ((F.greatest(F.size(values), F.lit(1)) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    summed = F.transform(blocks, lambda x: F.struct(x.alias("x"), F.aggregate(x, zero, merge).alias("t")))
    none = F.lit([]).cast("array<struct<x:array<int>,h:int>>")
    headed = F.aggregate(
        summed, F.struct(zero.alias("t"), none.alias("out")),
        lambda acc, s: F.struct(merge(acc["t"], s["t"]).alias("t"), F.concat(acc["out"], F.array(F.struct(s["x"].alias("x"), acc["t"].alias("h")))).alias("out")),
    )["out"]
    return F.flatten(F.transform(headed, lambda b: F.transform(b["x"], lambda v, i: F.aggregate(F.slice(b["x"], F.lit(1), i), b["h"], merge))))


def _word(text: Column, pattern: str) -> Column:
    return F.pmod(F.xxhash64(F.lower(F.regexp_extract(text, pattern, 1))), F.lit(64)).cast("int")


def _vote(by_kind: dict[str, tuple[str, str]], kind: str, value: Column) -> Column:
    good, bad = by_kind[kind]
    out = F.when(value.rlike(bad), -1) if bad else None
    if good:
        out = F.when(value.rlike(good), 1) if out is None else out.when(value.rlike(good), 1)
    return out.otherwise(0).cast("tinyint")


def _spans(kind: str, base: bool, x: Column) -> Column:
    """One match (``z``: m, the match; b and r, what stands before and after it; ``s``: where b begins) as a span with its votes."""
    value, start = x["z"]["m"], (x["s"] + F.length(x["z"]["b"])).cast("int")
    left, right = F.substring(x["z"]["b"], -40, 40), F.substring(x["z"]["r"], 1, 24)
    valid = _valid(kind, value)
    checks = kind in ("ip", "card", "phone", "ssn")
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"),
        (valid if base else F.lit(False)).alias("base"), (_plausible(kind, value) if base else F.lit(True)).alias("plausible"),
        _vote(_FORM, kind, value).alias("form"),
        (F.when(valid, 1).otherwise(-1) if checks else F.lit(0)).cast("tinyint").alias("check"),
        _vote(_GAZETTEER, kind, value).alias("gazetteer"),
        F.when(left.rlike(_FOR[kind]), 1).otherwise(0).cast("tinyint").alias("support"),
        F.when(left.rlike(_AGAINST), -1).otherwise(0).cast("tinyint").alias("oppose"),
        F.least(F.length(value), F.lit(40)).alias("f_length"),
        F.pmod(F.xxhash64(F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "0"), r"\p{L}+", "a")), F.lit(64)).cast("int").alias("f_shape"),
        _word(left, r"([\p{L}0-9]+)[^\p{L}0-9]*$").alias("f_left"), _word(right, r"^[^\p{L}0-9]*([\p{L}0-9]+)").alias("f_right"),
    )


def candidates(docs: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """``docs`` with all candidate spans, by start and kind, and the votes of the labelers (1 for, -1 against, 0 none) on each.

    Base spans are all kept; other candidates that overlap one of them go.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digit = text.rlike("[0-9]")
    patterns = [
        ("email", True, _EMAIL, F.contains(text, F.lit("@"))), ("ip", True, _IP, digit), ("card", True, _CARD, digit), ("phone", True, _PHONE, F.contains(text, F.lit("+")) & digit),
        *((k, False, p, text.rlike(needs)) for k, p, needs in _WIDE),
    ]
    at = range(len(patterns))
    none = F.lit([]).cast("array<string>")
    found = docs.withColumns({f"__m{i}": F.when(ok, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for i, (_, _, p, ok) in enumerate(patterns)})
    found = found.withColumns({f"__b{i}": F.when(F.size(f"__m{i}") > 0, F.split(text, patterns[i][2], -1)).otherwise(none) for i in at})
    n = lambda i: F.size(f"__m{i}")
    pair = lambda *names: lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1]))
    around = lambda i: F.zip_with(F.slice(f"__b{i}", F.lit(1), n(i)), F.slice(f"__b{i}", F.lit(2), n(i)), pair("b", "r"))
    found = found.withColumns({f"__z{i}": F.zip_with(f"__m{i}", around(i), lambda m, x: F.struct(m.alias("m"), x["b"].alias("b"), x["r"].alias("r"))) for i in at})
    found = found.withColumns({f"__l{i}": F.transform(f"__z{i}", lambda z: F.length(z["b"]) + F.length(z["m"])) for i in at})
    found = found.withColumns({f"__s{i}": _running(F.col(f"__l{i}"), F.lit(0), lambda a, b: a + b) for i in at})
    made = lambda kind, base: lambda x: _spans(kind, base, x)
    spans = [F.transform(F.zip_with(f"__z{i}", f"__s{i}", pair("z", "s")), made(k, base)) for i, (k, base, _, _) in enumerate(patterns)]
    found = found.withColumn("__all", F.array_sort(F.filter(F.concat(*spans), lambda s: s["base"] | s["plausible"])))
    # the furthest end of a base span before each candidate, and the nearest begin of one after it
    far = 2**31 - 1
    found = found.withColumns({
        "__ends": F.transform("__all", lambda s: F.when(s["base"], s["end"]).otherwise(0)),
        "__starts": F.transform(F.reverse("__all"), lambda s: F.when(s["base"], -s["start"]).otherwise(-far)),
    })
    higher = lambda a, b: F.greatest(a, b)
    found = found.withColumns({"__before": _running(F.col("__ends"), F.lit(0), higher), "__after": F.reverse(_running(F.col("__starts"), F.lit(-far), higher))})
    limits = F.zip_with("__before", "__after", pair("before", "after"))
    placed = F.zip_with("__all", limits, lambda c, x: F.struct(c.alias("c"), x["before"].alias("before"), x["after"].alias("after")))
    apart = F.filter(placed, lambda x: x["c"]["base"] | ((x["before"] <= x["c"]["start"]) & (-x["after"] >= x["c"]["end"])))
    kept = F.transform(apart, lambda x: F.struct(*(x["c"][f].alias(f) for f in ("kind", "start", "end", "base", *_LABELERS, *_FEATURES))))
    rest = [c for c in docs.columns if c != spans_col]
    return found.withColumn(spans_col, kept).select(*rest, spans_col)


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[list[dict[int, float]]], list[float]]:
    """Expectation-maximisation over vote patterns with their counts: prior, P(vote | class) by labeler, posteriors.

    Votes are independent given the class. The start takes the majority of votes; each estimate is smoothed by a few
    votes that are right more often than wrong, so that weights stay finite and the classes keep their names.
    """
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    prior, table_ = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        table_ = []
        for j in range(len(_LABELERS)):
            by_class = []
            for c in (0, 1):
                seen = {-1: 3.0 - 2 * c, 0: 2.0, 1: 1.0 + 2 * c}
                for p, (v, n) in zip(post, patterns):
                    seen[v[j]] += n * (p if c else 1 - p)
                whole = sum(seen.values())
                by_class.append({k: x / whole for k, x in seen.items()})
            table_.append(by_class)
        new = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][v[j]] / t[0][v[j]]) for j, t in enumerate(table_))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, post)), default=0)
        post = new
        if moved < 1e-9:
            break
    return prior, table_, post


def _keys(s: Column) -> Column:
    """The features of a span, keyed ``kind|feature|value`` (``kind|prior|`` stands for the kind)."""
    named = (F.concat(s["kind"], F.lit(f"|{f}|"), s[f].cast("string")) for f in (*_LABELERS, *_FEATURES))
    return F.array(F.concat(s["kind"], F.lit("|prior|")), *named)


def classifier(found: DataFrame, spans_col: str) -> dict[str, float]:
    """Naive Bayes log-odds of each feature value, by ``_keys``, trained on the posteriors of the vote patterns.

    The driver gets vote patterns with their counts (at most 3**5 for each kind) and summed posteriors of feature
    values (at most 250 for each kind): neither grows with the documents.
    """
    spans = found.select(F.explode(spans_col).alias("s"))
    counted = spans.select("s.*").groupBy("kind", *_LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    weights: dict[tuple, float] = {}
    for kind in sorted({r["kind"] for r in counted}):
        rows = sorted((tuple(int(r[x]) for x in _LABELERS), float(r["n"])) for r in counted if r["kind"] == kind)
        _, _, post = reliabilities(rows)
        weights |= {(kind, *v): p for (v, _), p in zip(rows, post)}
    if not weights:
        return {}
    votes = F.concat_ws("|", F.col("s.kind"), *(F.col(f"s.{x}").cast("string") for x in _LABELERS))
    learnt = found.sparkSession.createDataFrame([("|".join(map(str, k)), p) for k, p in weights.items()], "votes string, p double")
    # as many rows as vote patterns
    soft = spans.withColumn("votes", votes).join(F.broadcast(learnt), "votes")
    sums = soft.select("p", F.explode(_keys(F.col("s"))).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    seen = {r["f"]: (r["yes"], r["no"]) for r in sums}
    odds = {}
    for f, (yes, no) in sorted(seen.items()):
        kind, name, _ = f.split("|")
        all_yes, all_no = seen[f"{kind}|prior|"]
        wide = 3 if name in _LABELERS else 64
        odds[f] = math.log((all_yes + 1) / (all_no + 1)) if name == "prior" else math.log((yes + 1) / (all_yes + wide)) - math.log((no + 1) / (all_no + wide))
    return odds


def find(docs: DataFrame, *, text_col: str = "text", spans_col: str = "pii_spans", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (the columns of ``keep``, else all) with ``spans_col``: structs of kind, start, end, base, by start.

    Null texts count as empty; texts without candidates get an empty array; offsets are code points, ends exclusive.
    An existing column named ``spans_col`` is replaced, other columns stay, repeated rows are each returned, and an
    empty table gives an empty result.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != spans_col]
    found, _ = table(candidates(docs, text_col, spans_col).select(*kept, spans_col))
    odds = classifier(found, spans_col)
    weigh = F.create_map(*(x for k, v in odds.items() for x in (F.lit(k), F.lit(v)))) if odds else F.lit(None).cast("map<string,double>")
    total = lambda s: F.aggregate(_keys(s), F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(weigh, f), F.lit(0.0)))
    own = F.filter(spans_col, lambda s: s["base"] | (total(s) > 0))
    plain = F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.withColumn(spans_col, plain)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text, for each document."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    found = find(docs.select("doc_id", "text"), keep=("doc_id",))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(F.filter("pii_spans", lambda s: s["base"]), named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", named), ",").alias("spans"),
    )
