"""Language identification of pages by fusing four kinds of evidence.

The posterior of a language is proportional to its host prior, times the likelihood of the page's
text, of the language that its markup declares, and of the language that its address names. Text
likelihoods come from hashed byte n-grams of all documents of known language. Host priors are
smoothed along a hierarchy, host, domain and all pages, from grouped sums of every page's
posterior by the other evidence; a page's own share is taken out of its host and domain first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, steps, texts_of
from .quality_rules import gram_buckets

#: Bytes in an n-gram; log2 of the hash buckets; pseudo-count of a bucket.
GRAM, BITS, PSEUDO = 3, 15, 0.5
#: n-grams of a page that count as one: neighbours share bytes, so they are no independent evidence.
TEMPER = 10.0
#: Probability that a page's markup, or its address, names its language where it names one.
DECLARED, ADDRESSED = 0.85, 0.75
#: Pseudo-pages of the level above in the prior of a host, and of a domain.
HOST_WEIGHT, DOMAIN_WEIGHT = 4.0, 8.0
#: Languages whose likelihoods a task holds at once; more are scored one table after the other.
TABLE = 64
#: Hosts, or domains, with more than one page in so many meet their sums by broadcast, others in a shuffle join.
HOT = 1000

#: Address suffixes of countries and the language that most of their pages use.
SUFFIXES = {
    "ar": "es", "at": "de", "au": "en", "br": "pt", "ca": "en", "ch": "de", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cu": "es", "cz": "cs", "de": "de", "dk": "da", "ec": "es",
    "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "mc": "fr", "mx": "es", "nl": "nl", "no": "no", "nz": "en",
    "pe": "es", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "sn": "fr", "tr": "tr", "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es",
}
#: Labels below which countries register names, as in example.co.uk.
SECOND_LEVEL = ("ac", "asso", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "me", "ne", "net", "nom", "or", "org", "plc", "sch")

#: What begins a part of a page that isn't text, and what ends it.
_ENDS = {b"<head": b"</head>", b"<script": b"</script>", b"<style": b"</style>", b"<nav": b"</nav>", b"<!--": b"-->"}
_HIDDEN = re.compile(rb"<(?:(?:head|script|style|nav)\b|!--)")


def language_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(bucket, lang, n): n-grams of all documents whose language is known; a task sends a row for each bucket and language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in steps(offsets):
                bucket, first = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], GRAM, BITS)
                own = np.repeat(langs[a:b], np.diff(first))
                for name in set(langs[a:b]):
                    sums[name] = sums.get(name, 0) + np.bincount(bucket[own == name], minlength=1 << BITS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(used), pa.string()), pa.array(total[used])], names=["bucket", "lang", "n"])

    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return known.mapInArrow(count, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))


def log_likelihoods(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probability of each bucket in each of at most TABLE languages: 2**BITS rows for each come to the driver at most."""
    named = counts.sparkSession.createDataFrame(list(enumerate(langs)), "i int, _lang string")
    rows = counts.join(F.broadcast(named), F.col("lang") == F.col("_lang")).select("bucket", "i", "n").toPandas()
    n = np.full((1 << BITS, len(langs)), PSEUDO)
    n[rows["bucket"], rows["i"]] += rows["n"]
    return np.log(n / n.sum(0))


def domain_of(host):
    """Column: the name that was registered: the last two labels of a host, three where a country registers below such as co; an address of digits is its own."""
    second, top = F.substring_index(F.substring_index(host, ".", -2), ".", 1), F.substring_index(host, ".", -1)
    labels = F.when((F.length(top) == 2) & second.isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(labels)


def visible(html: str | None) -> bytes:
    """A page's text as UTF-8, with a space for each tag, comment, head, script, style and navigation; null is empty.

    One pass: what nothing closes is only a tag, or only text, and a search for an end that found
    none is not repeated; so the work grows in proportion to the page.
    """
    page = (html or "").encode()
    lower, out, at, missing = page.lower(), [], 0, set()
    while (tag := page.find(b"<", at)) >= 0:
        kind = _HIDDEN.match(lower, tag)
        for end in ([_ENDS[kind[0]]] if kind else []) + [b">"]:
            to = -1 if end in missing else lower.find(end, tag + 1)
            if to >= 0:
                break
            missing.add(end)
        else:
            break
        out += [page[at:tag], b" "]
        at = to + len(end)
    return b"".join([*out, page[at:]])


def evidence(pages: DataFrame, langs: list[str]) -> DataFrame:
    """(page_id, host, domain, declared, addressed, body): what a page says of itself, null where it says nothing known; body is the page itself."""
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1)
    opened = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*", 0)  # the first such tag alone
    declared = F.lower(F.regexp_extract(opened, r"""(?is)\blang\s*=\s*["']?([a-z]{2})""", 1))
    suffix = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.substring_index(host, ".", -1))
    known = lambda x: F.when(x.isin(langs), x)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain_of(host).alias("domain"), known(declared).alias("declared"), F.coalesce(known(path), known(suffix)).alias("addressed"), F.col("html").alias("body"))


def _says(named: np.ndarray, langs: list[str], right: float) -> np.ndarray:
    """Log likelihood of what a page names, for each language; 0 where it names none."""
    wrong = (1 - right) / max(len(langs) - 1, 1)
    hit = named[:, None] == np.array(langs, object)[None, :]
    return np.where(np.array([x is None for x in named])[:, None], 0.0, np.where(hit, np.log(right), np.log(wrong)))


def text_evidence(found: DataFrame, langs: list[str], counts: DataFrame) -> DataFrame:
    """found without its body, and scores: for each language, the log likelihood of text, markup and address together.

    Languages are scored TABLE at a time, in one pass over the batches; the log likelihoods so far are passed on beside the body.
    """
    passed = "page_id long, host string, domain string, declared string, addressed string, "
    for at in range(0, len(langs), TABLE):
        some = langs[at : at + TABLE]
        shared, last = found.sparkSession.sparkContext.broadcast(log_likelihoods(counts, some)), at + TABLE >= len(langs)

        def score(batches: Iterator[pa.RecordBatch], at=at, some=some, shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                body = batch.column("body") if at else pa.array([visible(x) for x in batch.column("body").to_pylist()], pa.binary()).cast(pa.string())
                data, offsets = texts_of(body)
                text = np.zeros((len(batch), at + len(some)))
                if at:
                    text[:, :at] = batch.column("text").flatten().to_numpy().reshape(len(batch), at)
                for a, b in steps(offsets):
                    bucket, first = gram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], GRAM, BITS)
                    owner = np.repeat(np.arange(b - a), np.diff(first))
                    for i in range(len(some)):
                        text[a:b, at + i] = np.bincount(owner, shared.value[bucket, i], b - a) / TEMPER
                kept = [batch.column(x) for x in ("page_id", "host", "domain", "declared", "addressed")]
                if not last:
                    yield pa.RecordBatch.from_arrays([*kept, body, pa.array(list(text), pa.list_(pa.float64()))], names=["page_id", "host", "domain", "declared", "addressed", "body", "text"])
                    continue
                for column, right in (("declared", DECLARED), ("addressed", ADDRESSED)):
                    text += _says(np.array(batch.column(column).to_pylist() + [None], object)[:-1], langs, right)
                p = np.exp(text - text.max(1, keepdims=True))
                p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(list(np.log(np.maximum(p, 1e-300))), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))], names=["page_id", "host", "domain", "declared", "addressed", "scores", "p"])

        found = found.mapInArrow(score, passed + ("scores array<double>, p array<double>" if last else "body string, text array<double>"))
    return found


def _meeting(pages: DataFrame, key: str, sums: DataFrame, own: str, total: int) -> DataFrame:
    """pages joined with the sums of their key: by broadcast if the sums are few, else those of hot keys alone (HOT of them at most), so that no key fills a task."""
    if is_small(sums):
        return pages.join(F.broadcast(sums.drop("rows")), F.col(key) == F.col(own))
    hot, cold = sums.where(F.col("rows") * HOT > total), sums.where(F.col("rows") * HOT <= total)
    common = pages.join(F.broadcast(hot.drop("rows")), F.col(key) == F.col(own))
    rare = pages.join(F.broadcast(hot.select(F.col(own).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    return common.unionByName(rare.join(cold.drop("rows"), F.col(key) == F.col(own)))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, probability, declared, addressed, host.

    lang is the language of the highest posterior, the first by name of equal ones. A page without
    text, markup or address is decided by its host and, for want of one, by all pages. If no
    document has a language, lang and probability are null. Repeated pages count as often in the
    priors; null urls share the empty host. An empty table gives no rows, and text of any length is
    read whole, in time linear in it. Any number of languages is scored. Other columns, whatever
    their names, are not read.
    """
    counts = materialize(language_counts(docs), "languages")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return evidence(pages, []).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "declared", "addressed", "host")
    scored = materialize(text_evidence(evidence(pages, langs), langs, counts), "evidence")
    each = range(len(langs))
    sums = lambda to: [F.sum(F.round(F.col("p")[i] * 1e9).cast("long")).alias(f"{to}{i}") for i in each]  # noqa: E731  sums of integers don't depend on their order
    vector = lambda of: F.array(*[F.col(f"{of}{i}") / 1e9 for i in each])
    hosts = materialize(scored.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("rows"), *sums("h")), "hosts")
    domains = materialize(scored.groupBy(F.col("domain").alias("_domain")).agg(F.count(F.lit(1)).alias("rows"), *sums("d")), "domains")
    everywhere = [(x or 0) / 1e9 for x in scored.agg(*sums("e")).first()]
    total = max(sum(everywhere), 1e-9)
    root = F.array(*[F.lit((x + 1) / (total + len(langs))) for x in everywhere])
    pages_ = scored.count()
    joined = _meeting(_meeting(scored, "host", hosts, "_host", pages_), "domain", domains, "_domain", pages_)
    joined = joined.withColumns({"at_host": vector("h"), "at_domain": vector("d")})

    def smoothed(counts: str, above, weight: float):
        own = F.zip_with(counts, "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda n, q: (n + weight * q) / (size + weight))

    prior = smoothed("at_host", smoothed("at_domain", root, DOMAIN_WEIGHT), HOST_WEIGHT)
    joined = joined.withColumn("w", F.zip_with("scores", prior, lambda s, q: s + F.ln(q))).withColumn("top", F.array_max("w"))
    weight = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return joined.select("page_id", F.element_at(F.array(*map(F.lit, langs)), F.array_position("w", F.col("top")).cast("int")).alias("lang"), (1 / weight).alias("probability"), "declared", "addressed", "host")
