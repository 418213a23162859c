"""Personal data: base patterns plus candidates judged by gradient-boosted trees. DataFrame and SQL functions only.

Base spans come from four patterns (`split` and `regexp_extract_all` over the same pattern give pieces and matches, and
running lengths give code-point offsets). The patterns are written so that matching is linear: runs are possessive and
can start only where a leftmost match can start.

High-recall generators propose overlapping spans: number-like tokens after single spaces give every window of up to
`MOST_DIGITS` digits (a card's 19; phones have 15) however they are grouped, text around an `@` gives an address. Boosted trees judge each by format and context features.
They learn from candidates whose answer is certain (equal to a base span, or to a base phone without its country code,
which shows national formats: 1; overlapping one of another kind, or
impossible as their kind: 0) in all documents of one half, and one threshold per kind is calibrated on all documents of the
other half to reach `PRECISION`. A candidate that only fails the base format (a national phone, a non-ASCII address) has
no label and is scored; no feature tells base format from other formats (a leading '+', ASCII), as every certain phone
has the '+'. Selected candidates that touch no base span are added where they overlap those in base format first, then
the best; base spans always stay.

Edge cases: null text = empty = no spans; an empty table or one without certain positives and negatives adds
nothing; repeated rows get the same spans each; other columns are ignored by the query and kept by `redact`.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.llm.common import shielded, text_or_empty, unshielded, written

KINDS = ("email", "ip", "card", "phone")
#: linear forms of the base patterns (same leftmost matches, but for those that always fail their check)
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",       # shorter chains fail anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NUMBER = r"(?<![0-9A-Za-z.])[+(]{0,2}[0-9][0-9().+/-]*+"
#: around every at sign: 64 code points of local part and 255 of domain at most (no valid address has more), up to white
#: space, quotes, brackets and the signs that set off a value
ADDRESS = r"[^\s@\"'`<>()\[\]{}=:,;|]{1,64}+@[^\s@\"'`<>()\[\]{}=:,;|]{1,255}+"
EDGE = r"^[^0-9\p{L}\p{M}._%+-]+"
#: any address has a domain of at least two non-empty labels
DOTTED = r"^[^@]+@[^@.]+(?:\.[^@.]+)+$"
#: calendar dates (y-m-d, d.m.y, m/d/y) and decimals
NO_PHONE = (r"^(?:(?:1[0-9]|20)[0-9]{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
            r"|(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[0-9]|20)[0-9]{2}|[0-9]+\.[0-9]+)$")
MOST_DIGITS = 19
BLOCK = 512
PRECISION = 0.995
BINS = 200
FEATURES = ["f_kind", "f_len", "f_digits", "f_groups", "f_longest", "f_spaces", "f_dots", "f_dashes", "f_parens",
            "f_luhn", "f_quad", "f_at_dots", "f_before", "f_after", "f_tokens", "f_first"]


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(part(i), F.lit(0))) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(p: Column) -> Column:
            q = F.regexp_replace(p, "^0+(?=.)", "")
            return (F.length(q) <= 3) & (F.substring(q, 1, 3).try_cast("int") <= 255)
        return F.forall(F.split(m, r"\."), small)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


_SPAN = "struct<start:int,end:int,m:string,b:string,a:string>"
CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, m, b, a>>: code-point offsets, text, the character before and after.

    Starts are running lengths of pieces and matches, summed in chunks, so that many matches in one text stay cheap."""
    def length(x: Column) -> Column:
        return F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def inside(chunk: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.length(x["p"])
            span = F.struct(start.alias("start"), (acc["pos"] + length(x)).alias("end"), x["m"].alias("m"),
                            F.right(x["p"], F.lit(1)).alias("b"), F.left(x["n"], F.lit(1)).alias("a"))
            return F.struct((acc["pos"] + length(x)).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.aggregate(chunk, F.struct(at.alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out")), step, lambda a: a["out"])

    def placed(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))

        def with_sums(cs: Column) -> Column:
            sums = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + length(x)))
            return _let(sums, lambda t: F.flatten(F.transform(cs, lambda c, i: inside(
                c, F.aggregate(F.slice(t, F.lit(1), i), F.lit(0), lambda s, x: s + x)))))
        return _let(chunks, with_sums)

    def zipped(pieces: Column) -> Column:
        pairs = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"),
                             F.slice(pieces, F.lit(2), F.size(pieces)).alias("n"))
        fields = F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["n"].alias("n")))
        return _let(fields, placed)

    found = _let(F.split(text, pattern, -1), zipped)
    return F.filter(found, lambda x: x["m"].isNotNull())


def _keeps(kind: str):
    return lambda x: valid(kind, x["m"])


def _as(kind: str, k: str, s: str, e: str):
    return lambda x: F.struct(F.lit(kind).alias(k), x["start"].alias(s), x["end"].alias(e))


def _near(kind: str):
    """k, s, e of a base span, and c: where a phone's national number starts after '+', country code and a space (else -1)."""
    def span(x: Column) -> Column:
        code = F.length(F.regexp_extract(x["m"], r"^\+[0-9]{1,3} ", 0)) if kind == "phone" else F.lit(0)
        return F.struct(F.lit(kind).alias("k"), x["start"].alias("s"), x["end"].alias("e"),
                        F.when(code > 0, x["start"] + code).otherwise(-1).alias("c"))
    return span


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _could(text: Column, kind: str) -> Column:
    """A cheap test that no text with a match fails."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ -]?[0-9]")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, _th (hash of the text: tells rows with the same id apart), text."""
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("_th", F.xxhash64("text"))


def base_spans(rows: DataFrame) -> DataFrame:
    """Add one array column per kind with the valid base spans."""
    out = rows
    for k in KINDS:
        found = F.filter(located(F.col("text"), BASE[k]), _keeps(k))
        out = out.withColumn(k, F.when(_could(F.col("text"), k), found).otherwise(_none()))
    return out


def windows(tokens: Column) -> Column:
    """Every number token, and every window of 7 to MOST_DIGITS digits of tokens that follow each other after single spaces."""
    def follows(k: Column) -> Column:
        return F.coalesce((F.get(tokens, k)["start"] == F.get(tokens, k - 1)["end"] + 1) & (F.get(tokens, k)["b"] == " "), F.lit(False))

    def digits(m: Column) -> Column:
        return F.length(F.regexp_replace(m, "[^0-9]", ""))

    def from_(x: Column, i: Column) -> Column:
        def step(acc: Column, d: Column) -> Column:
            y = F.get(tokens, i + d)
            n = acc["n"] + digits(y["m"])
            live = acc["live"] & follows(i + d) & F.coalesce(n <= MOST_DIGITS, F.lit(False))
            raw = F.concat(acc["raw"], F.lit(" "), y["m"])
            w = F.struct(x["start"].alias("at"), raw.alias("raw"), x["b"].alias("b"), y["a"].alias("a"), (d + 1).alias("tokens"))
            return F.struct(live.alias("live"), F.when(live, n).otherwise(acc["n"]).alias("n"), F.when(live, raw).otherwise(acc["raw"]).alias("raw"),
                            F.when(live & (n >= 7), F.concat(acc["out"], F.array(w).cast(_WINDOW))).otherwise(acc["out"]).alias("out"))
        one = F.array(F.struct(x["start"].alias("at"), x["m"].alias("raw"), x["b"].alias("b"), x["a"].alias("a"), F.lit(1).alias("tokens")))
        first = F.struct(F.lit(True).alias("live"), digits(x["m"]).alias("n"), x["m"].alias("raw"), one.cast(_WINDOW).alias("out"))
        # a token has a digit at least, so MOST_DIGITS tokens are enough
        more = F.when(follows(i + 1), F.sequence(F.lit(1), F.lit(MOST_DIGITS - 1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(more, first, step, lambda a: a["out"])

    return F.flatten(F.transform(tokens, from_))


_WINDOW = "array<struct<at:int,raw:string,b:string,a:string,tokens:int>>"


def _around(blocks: Column, w: Column) -> Column:
    """The base spans of all blocks that the window reaches."""
    first, last = [F.floor(at / BLOCK).cast("int") for at in (w["at"], w["at"] + F.length(w["raw"]) - 1)]
    return F.when(first == last, F.get(blocks, first)).otherwise(F.array_distinct(F.flatten(F.slice(blocks, first + 1, last - first + 1))))


def candidates(rows: DataFrame) -> DataFrame:
    """One row per proposed span with kind, features and what the base says of it. `rows` has text and the base arrays."""
    t = F.col("text")
    none = F.array().cast(_WINDOW)
    numbers = F.when(t.rlike("[0-9]"), _let(located(t, NUMBER), windows).cast(_WINDOW)).otherwise(none)
    mails = F.when(F.contains(t, F.lit("@")), F.transform(located(t, ADDRESS), lambda x: F.struct(
        x["start"].alias("at"), x["m"].alias("raw"), x["b"].alias("b"), x["a"].alias("a"), F.lit(1).alias("tokens"))).cast(_WINDOW)).otherwise(none)
    every = F.concat(*[F.transform(F.col(k), _near(k)) for k in KINDS])
    # base spans by text block, so that a window looks only at those around it
    blocks = _let(every, lambda e: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / BLOCK).cast("int")), lambda k: F.filter(
        e, lambda s: (s["s"] < (k + 1) * BLOCK) & (s["e"] > k * BLOCK))))
    near = rows.select("doc_id", "_th", F.concat(numbers, mails).alias("wins"), blocks.alias("blocks")).where(F.size("wins") > 0)
    # every window takes along the base spans it touches; neither the text nor the other spans go further
    touched = _let(F.col("blocks"), lambda bs: F.transform("wins", lambda w: F.struct(
        w["at"].alias("start"), w["raw"].alias("raw"), w["b"].alias("b"), w["a"].alias("a"), w["tokens"].alias("tokens"),
        F.filter(_around(bs, w), lambda s: (s["s"] < w["at"] + F.length(w["raw"])) & (s["e"] > w["at"])).alias("_base"))))
    r = near.select("doc_id", "_th", F.explode(touched).alias("r")).select("doc_id", "_th", "r.*")
    # punctuation around an address, and after a number, is not part of it
    head = F.when(F.contains("raw", F.lit("@")), F.length("raw") - F.length(F.regexp_replace("raw", EDGE, ""))).otherwise(0)
    r = r.withColumn("_head", head).withColumn("_rest", F.substring("raw", F.col("_head") + 1, F.length("raw")))
    r = r.withColumn("m", F.regexp_replace("_rest", r"[^0-9\p{L}\p{M}]+$", ""))
    r = r.withColumn("start", F.col("start") + F.col("_head"))
    r = r.where("m <> ''").withColumn("end", F.col("start") + F.length("m"))
    cut = F.length("m") < F.length("_rest")
    r = r.withColumn("before", F.when(F.col("_head") > 0, F.substring("raw", F.col("_head"), F.lit(1))).otherwise(F.col("b")))
    r = r.withColumn("after", F.when(cut, F.substring("_rest", F.length("m") + 1, F.lit(1))).otherwise(F.col("a")))
    m = F.col("m")
    digits = F.regexp_replace(m, "[^0-9]", "")
    nd = F.length(digits)
    quad = m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    kind = F.when(F.contains(m, F.lit("@")), "email").when(quad, "ip").when(m.startswith("+"), "phone") \
        .when(nd.between(16, 19) & m.rlike(r"^[0-9][0-9 -]*$"), "card").when(nd.between(7, 15), "phone")
    r = r.withColumn("kind", kind).where("kind IS NOT NULL")

    def cls(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4).cast("double")

    def count(pat: str) -> Column:
        return F.length(F.regexp_replace(m, f"[^{pat}]", "")).cast("double")

    groups = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    k = F.col("kind")
    ok = F.when(k == "email", m.rlike("^" + BASE["email"].replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "") + "$")) \
        .when(k == "ip", valid("ip", m)).when(k == "card", valid("card", m)) \
        .otherwise(m.rlike("^" + BASE["phone"] + "$") & valid("phone", m))
    f = {
        "f_kind": sum((F.when(k == x, float(i)).otherwise(0.0) for i, x in enumerate(KINDS)), F.lit(0.0)),
        "f_len": F.length(m).cast("double"), "f_digits": nd.cast("double"), "f_groups": F.size(groups).cast("double"),
        "f_longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "f_spaces": count(" "), "f_dots": count("."), "f_dashes": count(r"\-"), "f_parens": count("()"),
        "f_luhn": F.when(nd.between(12, 19), luhn(digits)).otherwise(False).cast("double"),
        "f_quad": F.when(quad, valid("ip", m)).otherwise(False).cast("double"),
        "f_at_dots": F.length(F.regexp_replace(F.substring_index(m, "@", -1), r"[^.]", "")).cast("double"),
        "f_before": cls(F.col("before")), "f_after": cls(F.col("after")), "f_tokens": F.col("tokens").cast("double"),
        "f_first": F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)),
    }
    # what cannot be of its kind, in whatever format
    never = F.when(k == "email", ~m.rlike(DOTTED)).when(k == "ip", ~valid("ip", m)).when(k == "card", ~valid("card", m)) \
        .otherwise(~nd.between(7, 15) | m.rlike(NO_PHONE) | F.col("after").rlike(r"[\p{L}%]"))
    other = F.exists("_base", lambda s: (s["k"] != F.col("kind")) & (s["s"] < F.col("end")) & (s["e"] > F.col("start")))
    same = F.exists("_base", lambda s: (s["k"] == F.col("kind")) & (s["e"] == F.col("end"))
                    & ((s["s"] == F.col("start")) | (s["c"] == F.col("start"))))
    touch = F.exists("_base", lambda s: (s["s"] < F.col("end")) & (s["e"] > F.col("start")))
    r = r.withColumns(f).withColumns({"touch": touch, "ok": ok, "label": F.when(same, 1.0).when(other | never, 0.0)})
    return r.select("doc_id", "_th", "kind", "start", "end", "touch", "ok", "label", *FEATURES).distinct()


def selected(cand: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Candidates that pass the trees and their kind's threshold and touch no base span. `cand` is a written stage."""
    certain = cand.where("label IS NOT NULL")
    none = cand.where("false").withColumn("score", F.lit(0.0))
    # even documents train, odd ones calibrate
    half = F.pmod(F.xxhash64("doc_id", "_th"), F.lit(2))
    pick = VectorAssembler(inputCols=FEATURES, outputCol="v")
    known = pick.transform(certain.withColumn("_half", half)).select("kind", "label", "_half", "v")
    fit = known.where("_half = 0").select("label", "v")
    if fit.select("label").distinct().count() < 2:
        return none
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=8, maxDepth=4, maxBins=32, stepSize=0.3, seed=7,
                          cacheNodeIds=False).fit(fit)

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", vector_to_array("probability")[1])

    bins = scored(known.where("_half = 1")).groupBy("kind", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()      # at most kinds x (BINS + 1) rows
    cut = F.lit(None).cast("double")
    for k in KINDS:
        pos = tot = 0.0
        best = None
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            pos, tot = pos + r["pos"], tot + r["n"]
            if pos / tot >= precision:
                best = r["bin"] / BINS
        if best is not None:
            cut = F.when(F.col("kind") == k, F.lit(float(best))).otherwise(cut)
    open_ = pick.transform(cand.where("NOT touch AND label IS NULL"))
    return scored(open_).where(F.col("score") >= cut).drop("v", "rawPrediction", "probability", "prediction")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _th, base (array<struct<kind, start, end>>), spans (base + added), one row per input row."""
    rows = keyed(docs)
    with_base = base_spans(rows)
    base = with_base.select("doc_id", "_th", F.concat(*[F.transform(k, _as(k, "kind", "start", "end")) for k in KINDS]).alias("base"))
    cand = written(candidates(with_base), "pii-candidates")
    chosen = selected(cand)
    best = F.sort_array(F.collect_set(F.struct((~F.col("ok")).alias("f"), (-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("l"),
                                               "start", "end", "kind")))
    taken = F.aggregate("best", F.array().cast("array<struct<kind:string,start:int,end:int>>"), lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))))
    more = chosen.groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).agg(best.alias("best")).select(
        "_d", "_t", taken.alias("more"))
    out = base.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))),
                                     lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"),
                                                        s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select("doc_id", "_th", "base", F.transform(every, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def joined(col: str) -> Column:
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by [KIND]; overlapping spans are replaced as one, named after the first.
    n_chars, where present, follows the new text; rows without spans come back unchanged."""
    found = find_spans(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "spans").dropDuplicates(["_d", "_t"])
    out = shielded(docs, "doc_id", "text").withColumn("_th", F.xxhash64(text_or_empty())).join(
        found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cut = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        fresh = x["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], F.array(
            cut, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, empty, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(
        F.col("text"), a["pos"] + 1, F.length("text"))))
    new = F.when(F.col("spans").isNotNull(), done).otherwise(F.col("text"))
    out = out.withColumn("_new", new)
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        old = F.col(f"k_{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("_new").cast(dict(docs.dtypes)["n_chars"])).otherwise(old)
    return unshielded(out, docs, **changed)
