"""Language identification by Bayesian evidence fusion.

Four kinds of evidence add up as log weights for each language: the text under a model of hashed byte trigrams, the language
that the markup declares, the suffix of the address, and a prior of the host.  How far declarations and suffixes can be
trusted, and the priors, are counted over the whole table from the texts' own posteriors, by grouped aggregation; a host's
prior is smoothed towards its domain's and that towards the table's.  All counts leave the row itself out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import sample_by_hash, small, stash

BUCKETS = 1 << 16
#: The text model is fitted on about so many labelled documents, those of least key hash.
SAMPLE_DOCS = 8_000
_OPENING = re.compile(r"(?i)<(?:(script|style|noscript)\b|(!--))?|&#?\w+;")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript")}


def visible_text(html: str) -> str:
    """Markup's text: tags, scripts, styles, comments and entities become blanks.

    What is not closed is taken for a plain tag, and a `<` without a `>` for text.  Every closing mark is looked for from
    left to right and given up once there is none, so a page takes time in proportion to its length.
    """
    out, at, lost = [], 0, set()
    while (m := _OPENING.search(html, at)) is not None:
        out.append(html[at : m.start()])
        if m[0][0] == "&":
            at = m.end()
            out.append(" ")
            continue
        kind, end = (m[1] or m[2] or "").lower(), -1
        if kind and kind not in lost:
            if kind == "!--":
                end = html.find("-->", m.end()) + 3
            else:
                end = found.end() if (found := _CLOSING[kind].search(html, m.end())) else 2
            if end == 2:
                lost.add(kind)
                end = -1
        if end < 0 and "tag" not in lost:
            end = html.find(">", m.start()) + 1
            if not end:
                lost.add("tag")
                end = -1
        if end < 0:
            out.append(html[m.start() : m.end()])
            at = m.end()
        else:
            out.append(" ")
            at = end
    out.append(html[at:])
    return "".join(out)


def trigram_buckets(text: str) -> np.ndarray:
    """Hash buckets of a text's byte trigrams, lower-cased; runs of other than letters are one blank."""
    data = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-8", "ignore"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    return ((data[:-2] * 31_337 + data[1:-1] * 257 + data[2:]) * 2_654_435_761 & 0xFFFFFFFF) >> 16


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_odds: np.ndarray  # languages x BUCKETS, float32

    def scores(self, text: str, temper: float) -> np.ndarray:
        """Log likelihoods, up to a constant.  Neighbouring trigrams say much the same, so a text counts as at most
        `temper` independent ones."""
        at = trigram_buckets(text)
        if not len(at):
            return np.zeros(len(self.languages))
        mean = self.log_odds[:, at].mean(axis=1, dtype=np.float64)
        return (mean - mean.max()) * min(len(at), temper)


def fit_text_model(labelled: DataFrame, text: str, language: str, key: str, sample: int = SAMPLE_DOCS, smoothing: float = 0.5) -> TextModel:
    """Trigram log probabilities of each language, from about `sample` labelled rows; at most languages x BUCKETS counts reach the driver."""
    rows = labelled.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    chosen = sample_by_hash(rows, key, sample, rows.count()).select(F.col(language).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, body in zip(batch["lang"], batch["text"], strict=True):
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(trigram_buckets(body), minlength=BUCKETS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    found = chosen.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    smooth = counts + smoothing
    return TextModel(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))


def declared_language(html: Column) -> Column:
    """The primary language subtag that markup declares in its first html element, lower-cased; null where it declares none."""
    at = F.regexp_instr(html, F.lit(r"(?i)<html\b"))
    tag = F.when(at > 0, F.substring_index(F.substr(html, at), ">", 1))
    found = F.lower(F.regexp_extract(tag, r"(?i)^<html\b.*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    """The host's last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column, host: Column) -> Column:
    """Top-level domain, and a two-letter first path segment if there is one: `com/fr`."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([A-Za-z]{2})(?:[-/?#]|$)", 1))
    return F.concat(F.substring_index(host, ".", -1), F.when(path != "", F.concat(F.lit("/"), path)).otherwise(""))


def identify(rows: DataFrame, model: TextModel, *, markup: bool, text: str = "text", temper: float = 60.0, strength: float = 5.0, trust: float = 2.0, floor: float = 1e-3) -> DataFrame:
    """Add language, confidence, text_language, text_confidence and language_scores (one posterior a language of the model).

    `rows` has the column `text` (markup: its visible text is taken) and may have declared, suffix, host and domain
    (strings; absent or null is no evidence, and so is a value that no other row has).  Ties go to the language first by name.  Null and empty texts say nothing:
    the other evidence and the table's prior decide.  Rows stay one to one; the text column goes, other columns pass through, and columns named like
    the outputs are replaced.  A model without languages gives nulls; an empty table gives no rows.
    """
    outputs = ("language", "confidence", "text_language", "text_confidence", "language_scores")
    names = [c for c in rows.columns if c not in outputs]
    kinds = [c for c in ("declared", "suffix") if c in names]
    k = len(model.languages)
    if not k:
        return rows.select(*names, *[F.lit(None).cast(t).alias(c) for c, t in zip(outputs, ("string", "double", "string", "double", "array<double>"), strict=True)])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.scores(visible_text(x or "") if markup else x or "", temper) for x in texts])

    langs = range(k)
    parts = lambda prefix: [f"{prefix}{i}" for i in langs]

    def normal(logs: list[Column]) -> list[Column]:
        top = F.greatest(*logs) if k > 1 else logs[0]
        return [F.exp(x - top) for x in logs]

    kept = [c for c in names if c != text]
    scored = rows.select(*kept, likelihoods(F.col(text)).alias("__ll"))
    flat = stash(scored.select(*kept, *[F.col("__ll")[i].alias(f"l{i}") for i in langs]), "lang-text")
    raw = normal([F.col(f"l{i}") for i in langs])
    total = sum(raw[1:], raw[0])
    base = flat.select("*", *[(r / total).alias(f"p{i}") for i, r in enumerate(raw)])
    soft = [F.sum(f"p{i}").alias(f"s{i}") for i in langs]
    world = base.agg(*soft).first()
    mass = sum(world[f"s{i}"] or 0.0 for i in langs) + k
    prior = [((world[f"s{i}"] or 0.0) + 1.0) / mass for i in langs]
    done = base
    for kind in kinds:  # P(value | language) over P(value), smoothed towards 1, without the row itself
        table = stash(base.filter(F.col(kind).isNotNull()).groupBy(kind).agg(*soft), f"lang-{kind}")
        whole = table.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in langs]).first()
        alls = [float(whole[f"s{i}"] or 0.0) for i in langs]
        done = done.join(small(table.select(kind, *[F.col(f"s{i}").alias(f"{kind}_s{i}") for i in langs]), table.count()), kind, "left")
        others = [F.greatest(F.col(f"{kind}_s{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in langs]
        share = sum(others[1:], others[0]) / F.lit(max(sum(alls) - 1.0, 1.0))
        ratio = lambda i: (others[i] + trust * share) / (F.greatest(F.lit(alls[i]) - F.col(f"p{i}"), F.lit(0.0)) + trust) / share
        weights = [F.when(share > 1e-12, F.ln(F.greatest(ratio(i), F.lit(floor)))).otherwise(0.0).alias(f"{kind}{i}") for i in langs]
        done = done.select(*[c for c in done.columns if not c.startswith(f"{kind}_s")], *weights)
    if "host" in names:
        domains = stash(base.filter(F.col("domain").isNotNull()).groupBy("domain").agg(*[F.sum(f"p{i}").alias(f"d{i}") for i in langs]), "lang-domain")
        hosts = base.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min("domain").alias("domain"), *[F.sum(f"p{i}").alias(f"h{i}") for i in langs])
        hosts = stash(hosts.join(small(domains, domains.count()), "domain", "left").drop("domain"), "lang-host")
        done = done.join(small(hosts, hosts.count()), "host", "left")
        own = lambda c, i: F.greatest(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) - F.col(f"p{i}"), F.lit(0.0))
        d_sum, h_sum = (sum((own(c, i) for i in langs[1:]), own(c, 0)) for c in "dh")
        domain_prior = [(own("d", i) + strength * prior[i]) / (d_sum + strength) for i in langs]
        priors = [(own("h", i) + strength * domain_prior[i]) / (h_sum + strength) for i in langs]
    else:
        priors = [F.lit(p) for p in prior]
    logs = [F.col(f"l{i}") + F.ln(priors[i]) + sum((F.coalesce(F.col(f"{kind}{i}"), F.lit(0.0)) for kind in kinds), F.lit(0.0)) for i in langs]
    fused = done.select(*kept, *parts("p"), *[x.alias(f"f{i}") for i, x in enumerate(logs)])
    weights = normal([F.col(f"f{i}") for i in langs])
    out = fused.select(*kept, F.array(*[F.col(p) for p in parts("p")]).alias("__p"), F.array(*weights).alias("__w"))
    out = out.withColumn("__sum", F.aggregate("__w", F.lit(0.0), lambda a, x: a + x)).withColumn("language_scores", F.transform("__w", lambda w: w / F.col("__sum")))
    named = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.get(named, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return out.select(*kept, best("language_scores").alias("language"), F.array_max("language_scores").alias("confidence"), best("__p").alias("text_language"), F.array_max("__p").alias("text_confidence"), "language_scores")
