"""From features to a score, two channels of evidence, gates and a verdict; every step a column or a sum.

The long table of features meets the weights by cell and feature; sums by document give the logit and what the
verdict rules need, so a verdict is a chain of conditions over one row a document.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import sized

# The verdicts, and the thresholds of the scoring rules.
VERDICTS = ("insufficient_text", "likely_human", "leaning_human", "uncertain", "leaning_llm", "likely_llm")
EXPENSIVE = ("self_correction_marker", "idiolect_stability", "letter_elongation")
REGISTER_PROXIES = ("terminal_punct_ratio", "sentence_initial_caps", "em_dash_in_chat", "exclam_single_regular", "emoji_bullet_led", "politeness_formula", "greeting_signoff_frame", "tr_formal_copula", "out_of_channel_register", "llm_lexicon_weak", "colon_led_list")
AGGREGATE_DISABLED = ("out_of_channel_register", "paragraph_uniformity")
K, MATERIAL, LOW, HIGH = 2.0, 0.10, 0.25, 0.6
BANDS = ((19, "<20_tokens", None), (49, "20-49_tokens", 0.15), (149, "50-149_tokens", 0.30), (499, "150-499_tokens", 0.45), (None, "500+_tokens", 0.50))
GATES = {"chat": (100, 20, 3), "prose": (250, 50, 6)}
LABELS = {"insufficient_text": "not_enough_evidence", "likely_human": "human_style_indicators", "leaning_human": "human_style_indicators", "uncertain": "mixed_evidence", "leaning_llm": "ai_style_indicators", "likely_llm": "ai_style_indicators"}
KINDS = ("continuous", "rate", "binary")


def load_weights(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The weights table (cell, feature, w, mu, sigma, kind, b0) of a JSON document, and its other fields; raises on what is wrong with it."""
    doc = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    if problems := weight_problems(doc):
        raise ValueError("; ".join(problems))
    rows = [(cell, f, float(w), float(c.get("mu", {}).get(f, 0.0)), float(c.get("sigma", {}).get(f, 1.0) or 1.0), c["kind"][f], float(c["b0"])) for cell, c in doc["cells"].items() if "b0" in c for f, w in c["w"].items() if isinstance(w, int | float)]
    return spark.createDataFrame(rows, "cell string, feature string, w double, mu double, sigma double, kind string, b0 double"), {k: v for k, v in doc.items() if k != "cells"}


def weight_problems(doc: dict) -> list[str]:
    """Up to eight things wrong with a weights document."""
    out = [f"{k} is missing" for k in ("provenance", "weightsId", "generatedAt", "expiresAt", "K", "cells") if k not in doc]
    if doc.get("provenance") not in ("prior", "fitted"):
        out.append("provenance is prior or fitted")
    for cell, c in doc.get("cells", {}).items():
        out += [f"{cell}: kind of {f} is {c.get('kind', {}).get(f)!r}" for f in c.get("w", {}) if c.get("kind", {}).get(f) not in KINDS]
    if not any("b0" in c and c.get("w") for c in doc.get("cells", {}).values()):
        out.append("no usable cell")
    return out[:8]


def weights_document(weights: DataFrame, provenance: str, weights_id: str, generated_at: str, expires_at: str, k: float = K) -> dict:
    """The JSON document of a weights table (cell, feature, w, mu, sigma, kind, b0), as load_weights() reads it; raises on what is wrong with it."""
    cells: dict = {}
    for r in weights.orderBy("cell", "feature").collect():
        c = cells.setdefault(r["cell"], {"b0": r["b0"], "w": {}, "mu": {}, "sigma": {}, "kind": {}})
        for name in ("w", "mu", "sigma", "kind"):
            c[name][r["feature"]] = r[name]
    doc = {"provenance": provenance, "weightsId": weights_id, "generatedAt": generated_at, "expiresAt": expires_at, "K": k, "cells": cells}
    if problems := weight_problems(doc):
        raise ValueError("; ".join(problems))
    return doc


def combined(cli: Column, judge: Column) -> Column:
    """struct(verdict, conflict): the verdict of the scores and a judge's together, by the fixed matrix; null for other words."""
    order = ("likely_llm", "leaning_llm", "uncertain", "leaning_human", "likely_human", "insufficient_text")
    # A row for each verdict of the scores, a column for each of the judge, both in that order.
    matrix = {
        "likely_llm": ("likely_llm", "leaning_llm", "leaning_llm", "uncertain", "uncertain", "uncertain"), "leaning_llm": ("leaning_llm", "leaning_llm", "uncertain", "uncertain", "uncertain", "uncertain"),
        "uncertain": ("leaning_llm", "uncertain", "uncertain", "uncertain", "leaning_human", "uncertain"), "leaning_human": ("uncertain", "uncertain", "uncertain", "leaning_human", "leaning_human", "uncertain"),
        "likely_human": ("uncertain", "uncertain", "leaning_human", "leaning_human", "likely_human", "leaning_human"), "insufficient_text": ("insufficient_text",) * 6,
    }
    both = F.concat_ws("|", cli, judge)
    table = F.create_map(*(F.lit(x) for a in order for b, v in zip(order, matrix[a], strict=True) for x in (f"{a}|{b}", v)))
    conflict = (cli.isin("likely_llm", "leaning_llm") & judge.isin("leaning_human", "likely_human")) | (cli.isin("leaning_human", "likely_human") & (judge == "likely_llm"))
    return F.struct(table[both].alias("verdict"), conflict.alias("conflict"))


def caveats(verdict: Column, provenance: str, n_tokens: Column, language: Column) -> Column:
    """The names of what a reader must be told beside a verdict."""
    leans = verdict.isin("leaning_llm", "likely_llm")
    told = F.array(
        F.when(verdict != "insufficient_text", F.lit("base_rate")), F.when(F.lit(provenance == "prior"), F.lit("uncalibrated")), F.when(n_tokens < 150, F.lit("short_text")),
        F.when(language == "tr", F.lit("turkish")), F.when(leans, F.lit("non_native_writers")), F.when(leans, F.lit("few_calibration_writers")),
    )
    return F.filter(told, lambda x: x.isNotNull())


def with_fallback(weights: DataFrame, prior: DataFrame) -> DataFrame:
    """weights with the cells of prior that it lacks; column fallback tells them."""
    lacking = prior.join(weights.select("cell").distinct(), "cell", "left_anti")
    return weights.withColumn("fallback", F.lit(False)).unionByName(lacking.withColumn("fallback", F.lit(True)))


def transformed(kind: Column, x: Column, mu: Column, sigma: Column) -> Column:
    v = F.when(kind == "rate", F.log1p(F.greatest(F.lit(0.0), x))).otherwise(x)
    z = (v - F.coalesce(mu, F.lit(0.0))) / F.coalesce(F.nullif(sigma, F.lit(0.0)), F.lit(1.0))
    return F.when(kind == "binary", F.when(x != 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)))


def contributions(features: DataFrame, weights: DataFrame) -> DataFrame:
    """features with w, z and raw, the signed contribution; rows without a weight go.

    features: cell, feature, value, direction, and language and domain if weights depend on them: halved where the
    language is not certain, none for politeness in customer service.
    """
    rows = features.drop("kind").join(sized(weights), ["cell", "feature"])
    w = F.col("w")
    if "language" in features.columns:
        w = F.when(F.col("language").isin("mixed", "unknown", "unsupported"), w / 2).otherwise(w)
    if "domain" in features.columns:
        w = F.when((F.col("domain") == "customer_service") & (F.col("feature") == "politeness_formula"), 0.0).otherwise(w)
    rows = rows.withColumn("w", w).withColumn("z", transformed(F.col("kind"), F.col("value"), F.col("mu"), F.col("sigma")))
    return rows.withColumn("raw", F.when(F.col("direction") == "llm", 1.0).otherwise(-1.0) * F.col("w") * F.col("z"))


def band(n_tokens: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for most, name, _ in reversed(BANDS[:-1]):
        out = F.when(n_tokens <= most, name).otherwise(out)
    return out


def cap(n_tokens: Column) -> Column:
    out = F.lit(BANDS[-1][2])
    for most, _, c in reversed(BANDS[:-1]):
        out = F.when(n_tokens <= most, F.lit(c).cast("double")).otherwise(out)
    return out


def capping(logit: Column, n_tokens: Column) -> Column:
    """The factor that keeps the score within the band's distance of one half."""
    c = cap(n_tokens)
    limit = F.log((0.5 + c) / (0.5 - c))
    return F.when(c.isNull() | (c >= 0.5) | (F.abs(logit) <= limit), 1.0).otherwise(limit / F.abs(logit))


def sums(rows: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """docs (key, n_tokens, b0, ...) with logit, factor, score and what the verdict needs of the contributions.

    A document's contributions (no more than there are features) meet in one array, in the order of the features, so
    one shuffle is enough and sums don't depend on the order of rows. Without any, the logit is b0.
    """
    item = F.struct("feature", "raw", "w", "z", "direction", "feature_group", "confidence")
    found = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    docs = docs.join(found, key, "left").withColumn("_c", F.coalesce("_c", F.array().cast(found.schema["_c"].dataType)))
    total = lambda of: F.aggregate("_c", F.lit(0.0), lambda a, x: a + of(x))
    docs = T.barrier(docs.withColumn("logit", F.coalesce("b0", F.lit(0.0)) + total(lambda x: x["raw"])))
    docs = T.barrier(docs.withColumn("factor", capping(F.col("logit"), F.col("n_tokens"))))
    llm, human = (lambda x: x["direction"] == "llm"), (lambda x: x["direction"] == "human")
    toward = lambda x: F.greatest(F.lit(0.0), x["w"] * x["z"])
    mine = lambda x: (F.abs(x["raw"]) > 1e-12) & (x["w"] * x["z"] > 0)
    solid = lambda x: llm(x) & ~x["feature"].isin(*REGISTER_PROXIES) & (x["raw"] * F.col("factor") >= MATERIAL)
    count = lambda test: F.size(F.filter("_c", test)).cast("long")
    groups = lambda test: F.size(F.array_distinct(F.transform(F.filter("_c", test), lambda x: x["feature_group"]))).cast("long")
    docs = docs.withColumns({
        "active": count(lambda x: F.lit(True)), "firm": count(lambda x: x["confidence"].isin("HIGH", "MED")),
        "llm_sum": total(lambda x: F.when(llm(x), toward(x)).otherwise(0.0)), "human_sum": total(lambda x: F.when(human(x), toward(x)).otherwise(0.0)),
        "n_llm": count(lambda x: llm(x) & mine(x)), "g_llm": groups(lambda x: llm(x) & mine(x)), "n_human": count(lambda x: human(x) & mine(x)), "g_human": groups(lambda x: human(x) & mine(x)),
        "n_solid": count(solid), "g_solid": groups(solid), "n_strong_human": count(lambda x: human(x) & mine(x) & (x["confidence"] == "HIGH")),
        "n_expensive": count(lambda x: human(x) & mine(x) & x["feature"].isin(*EXPENSIVE)), "n_human_own": count(lambda x: human(x) & mine(x) & (x["feature"] != "history_consistency")),
    })
    return T.barrier(docs.drop("_c")).withColumns({
        "score": 1 / (1 + F.exp(-F.col("logit") * F.col("factor"))),
        "llm_channel": 1 - F.exp(-F.col("llm_sum") / K), "human_channel": 1 - F.exp(-F.col("human_sum") / K), "band": band(F.col("n_tokens")),
    })


def gate(shape: Column, aggregate: Column) -> Column:
    """The first gate that fails, else null. Needs chars, n_tokens, language, active, firm."""
    least = lambda i: F.when(aggregate | (shape == "chat"), GATES["chat"][i]).otherwise(GATES["prose"][i])
    return (
        F.when(F.col("language") == "unsupported", "G3_lang").when(F.col("chars") < least(0), "G1_chars").when(F.col("n_tokens") < least(1), "G2_tokens")
        .when(F.col("language") == "unknown", "G3_lang").when(F.col("active") < least(2), "G4_features").when(F.col("firm") == 0, "G5_confidence")
    )


def table_verdict(llm: Column, human: Column) -> Column:
    mid_llm, mid_human = llm >= LOW, human >= LOW
    return (
        F.when(llm > HIGH, F.when(~mid_human, "leaning_llm").otherwise("uncertain"))
        .when(mid_llm, F.when(~mid_human, "leaning_llm").when(human > HIGH, "leaning_human").otherwise("uncertain"))
        .otherwise(F.when(mid_human, "leaning_human").otherwise("insufficient_text"))
    )


def toward_uncertain(v: Column) -> Column:
    """One step nearer to uncertain."""
    return F.when(v == "likely_human", "leaning_human").when(v.isin("leaning_human", "leaning_llm"), "uncertain").when(v == "likely_llm", "leaning_llm").otherwise(v)


def verdicts(scored: DataFrame, provenance: str = "prior", expires_at: str | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """scored with gate, verdict, caveats, warnings and label. scored: sums() with shape, genre, language, chars, rules and aggregate."""
    c = F.col
    d = scored.withColumns({"gate": gate(c("shape"), c("aggregate")), "_rules": F.filter("rules", lambda r: r["direction"] == "llm")})
    prints = F.size(F.filter("_rules", lambda r: (r["precision"] == "high") & (r["name"] != "near_duplicate")))
    d = d.withColumns({"_prints": prints, "_n": F.size("_rules"), "_marker": F.exists("_rules", lambda r: r["name"] == "known_machine_marker"), "_v0": table_verdict(c("llm_channel"), c("human_channel"))})
    stopped = c("gate").isNotNull() & ((c("_prints") == 0) | (c("gate") == "G3_lang"))
    lone = (c("_v0").isin("leaning_llm") & ~((c("n_llm") >= 2) & (c("g_llm") >= 2))) | (c("_v0").isin("leaning_human") & ~((c("n_human") >= 2) & (c("g_human") >= 2)))
    d = d.withColumn("_v1", F.when(lone, "uncertain").otherwise(c("_v0")))
    proxy = (c("_v1") == "leaning_llm") & ~((c("n_solid") >= 2) & (c("g_solid") >= 2))
    hybrid = (c("llm_channel") > HIGH) & (c("n_strong_human") >= 2)
    forwarded = (c("_n") == 1) & c("_marker") & ((c("human_channel") > HIGH) | ((c("n_human") >= 2) & (c("g_human") >= 2))) & c("gate").isNull()
    v2 = F.when(proxy | hybrid, "uncertain").otherwise(c("_v1"))
    # a verdict on the machine side stays where it is stronger; any other one becomes the rule's
    v3 = F.when(forwarded, "uncertain").when((c("_prints") >= 1) | (c("_n") >= 2), "likely_llm").when(c("_n") == 1, "leaning_llm").otherwise(v2)
    promoted = (v3 == "leaning_human") & c("aggregate") & (c("_n") == 0) & (c("n_human_own") >= 3) & (c("n_expensive") >= 1)
    v4 = F.when(promoted, "likely_human").otherwise(v3)
    lean = c("band").isin(BANDS[1][1], BANDS[2][1]) & (c("_prints") == 0)
    v5 = F.when(lean & (v4 == "likely_llm"), "leaning_llm").when(lean & (v4 == "likely_human"), "leaning_human").when((c("band") == BANDS[0][1]) & (c("_prints") == 0), "insufficient_text").otherwise(v4)
    d = d.withColumns({"_proxy": proxy, "_hybrid": hybrid | forwarded, "_v5": F.when(stopped, "insufficient_text").otherwise(v5)})
    v6 = F.when((c("genre") == "marketing") & (c("_n") == 0) & c("_v5").isin("leaning_llm", "likely_llm"), "uncertain").otherwise(c("_v5"))
    if provenance == "prior":
        v6 = F.when((v6 == "likely_llm") & (c("_n") == 0), "uncertain").when((v6 == "likely_human") & ~c("aggregate"), "leaning_human").otherwise(v6)
    expired = bool(now and expires_at and now > datetime.datetime.fromisoformat(expires_at.replace("Z", "+00:00")))
    if expired:
        v6 = toward_uncertain(v6)
    d = d.withColumn("verdict", v6)
    odd = ((c("score") > 0.7) & c("verdict").isin("likely_human", "leaning_human")) | ((c("score") < 0.3) & c("verdict").isin("likely_llm", "leaning_llm"))
    told = F.array(
        F.when((c("llm_channel") > HIGH) & (c("human_channel") > HIGH), F.lit("contradictory_evidence")),
        F.when(c("_proxy") & ~c("verdict").isin("likely_llm", "leaning_llm"), F.lit("register_only_evidence")),
        F.when(c("_hybrid"), F.lit("hybrid_suspect")), F.when(F.exists("rules", lambda r: r["warning"].isNotNull()), F.lit("pasted_machine_text")),
        F.when(odd, F.lit("score_verdict_disagreement")), F.when(F.lit(provenance == "prior"), F.lit("uncalibrated_weights")),
        F.when(F.lit(expired), F.lit("weights_expired")), F.when(F.lit(now is None), F.lit("expiry_not_checked")),
    )
    names = F.create_map(*(F.lit(x) for p in LABELS.items() for x in p))
    copied = (c("_n") == 1) & F.exists("_rules", lambda r: r["name"] == "near_duplicate")
    d = d.withColumn("caveats", caveats(c("verdict"), provenance, c("n_tokens"), c("language")))
    d = d.withColumns({"warnings": F.filter(told, lambda x: x.isNotNull()), "label": F.when(copied, "not_independently_authored").otherwise(names[c("verdict")]), "score": F.when(c("verdict") != "insufficient_text", F.round("score", 12))})
    return d.drop("_rules", "_prints", "_n", "_marker", "_v0", "_v1", "_proxy", "_hybrid", "_v5")


def signals(rows: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """key, signals: by the size of the contribution, then by name; the first `most` of them."""
    item = F.struct((-F.abs("raw")).alias("neg"), "feature", "value", "z", "raw")
    every = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    named = F.transform("s", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["z"].alias("z"), x["raw"].alias("contribution")))
    return every.select(*key, (F.slice(named, 1, most) if most else named).alias("signals"))


def broken_sums(rows: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose contributions and intercept don't add up to the logit; an invariant, so this is empty."""
    total = rows.groupBy(*key).agg((F.sum("raw") + F.first("b0")).alias("total"))
    return scored.join(total, key).where(F.abs(F.col("total") - F.col("logit")) > 1e-9)


def triage(scored: DataFrame, key: str, most: int = 40, audit: float = 0.1) -> DataFrame:
    """What people look at first: uncertain and leaning rows and a tenth of the confident ones, nearest to one half, at most 40."""
    sample = T.fnv1a_32(F.concat(F.lit("triage|"), F.col(key).cast("string"))) % 1000 < int(audit * 1000)
    near = F.round(F.abs(F.col("score") - 0.5), 9)
    return scored.where(F.col("verdict").isin("uncertain", "leaning_llm", "leaning_human") | (F.col("verdict").startswith("likely") & sample)).orderBy(near.asc_nulls_last(), key).limit(most)
