"""Which models a text speaks of: keywords in two tiers, folded to one pattern for each model and tier, or as a table of any size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import text

# Texts about local open-weight models, and explicit names that outweigh them.
LOCAL_MODELS = [r"\bgpt[:\-\s]?oss\b", r"\boss[-\s]?(?:20b|120b)\b", r"\bself-?hosted\b", r"\blocal llms?\b", r"\bhome lab\b", r"\bollama\b", r"\blm studio\b", r"huggingface\.co/openai/gpt-oss"]
EXPLICIT = [r"\bchat\s?gpt\b", r"\bgpt[-\s]?4o\b", r"\bgpt[-\s]?5(?:\.4)?\b", r"\bo4(?:-mini)?\b"]
VETOED = ("chatgpt", {"gpt", "openai"})
SIGNS = re.compile("([^a-z0-9_]+)")
#: Up to so many keywords are sent to the runs of words; with more, both are dealt out by their letters.
FEW = 100_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class Keyword:
    """A word that names a model: surely (tier high), or only beside one of the context words if there are any."""

    slug: str
    word: str
    tier: str = "high"
    context: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        return r"\b" + re.sub(r"[-.]", lambda _: r"[-\s.]?", self.word) + r"\b"


def models_of(body: Column, keywords: list[Keyword]) -> Column:
    """Slugs of the models that a text names, as a sorted array. One pattern for each kind, no join.

    Most texts hold none of the words; one look for these, without regard to their bounds, spares them the exact patterns.
    """
    words = sorted({re.sub(r"[-.]", lambda _: r"[-\s.]?", k.word) for k in keywords})
    slugs = sorted({k.slug for k in keywords})
    local = text.any_of(body, LOCAL_MODELS) & ~text.any_of(body, EXPLICIT)
    out = []
    for slug in slugs:
        own = [k for k in keywords if k.slug == slug]
        sure = [k.pattern for k in own if k.tier == "high"]
        hit = text.any_of(body, sure) if sure else F.lit(False)
        for k in own:
            if k.tier != "high":
                near = F.lit(True) if not k.context else body.rlike("(?i)" + "|".join(map(re.escape, k.context)))
                veto = local if slug == VETOED[0] and k.word in VETOED[1] else F.lit(False)
                hit = hit | (text.has(body, k.pattern) & near & ~veto)
        out.append(F.when(hit, F.lit(slug)))
    return F.when(body.rlike("(?i)" + "|".join(words)), F.array_compact(F.array(*out))).otherwise(F.array().cast("array<string>"))


def models_of_sql(body: str, keywords: list[Keyword]) -> str:
    """The same as a list of slugs in SQL."""
    local = f"({text.any_of_sql(body, LOCAL_MODELS)} AND NOT {text.any_of_sql(body, EXPLICIT)})"
    parts = []
    for slug in sorted({k.slug for k in keywords}):
        hits = []
        for k in (k for k in keywords if k.slug == slug):
            hit = text.has_sql(body, k.pattern)
            if k.tier != "high":
                if k.context:
                    hit += f" AND {text.has_sql(body, '|'.join(map(re.escape, k.context)))}"
                if slug == VETOED[0] and k.word in VETOED[1]:
                    hit += f" AND NOT {local}"
            hits.append(f"({hit})")
        parts.append(f"CASE WHEN {' OR '.join(hits)} THEN '{slug}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def keyword_table(spark, keywords: list[Keyword]) -> DataFrame:
    """Keywords as rows (slug, word, tier, context), the context words joined by commas."""
    return spark.createDataFrame([(k.slug, k.word, k.tier, ",".join(k.context) or None) for k in keywords], "slug string, word string, tier string, context string")


def runs_met(low: str, longest: int, known: Callable[[set[str]], set[str]]) -> set[tuple[str, str]]:
    """(letters, piece): the runs of at most ``longest`` words of a text in lower case whose letters and digits are among those that may be a keyword's, with the piece of text that they are."""
    parts = SIGNS.split(low)  # words and the signs between them in turn; what is outside the first and the last word falls away
    parts = parts[0 if parts[0] else 2 : None if parts[-1] else -2]
    words, letters, met = parts[::2], parts[::2], set()
    for n in range(1, min(longest, len(words)) + 1):
        if n > 1:
            letters = list(map(str.__add__, letters, words[n - 1 :]))
        if hits := known(set(letters)):
            met.update((x, "".join(parts[2 * i : 2 * (i + n) - 1])) for i, x in enumerate(letters) if x in hits)
    return met


def places_of(known: DataFrame, places: int) -> bytes:
    """A bit for each of ``places``, set where a keyword's letters fall by their checksum: of bounded size, whatever the number of keywords."""
    place = F.crc32(F.col("letters").cast("binary")) % places
    words = known.select(place.alias("p")).groupBy(F.expr("p div 64").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).collect()
    out = np.zeros(places // 64, "<i8")
    for w in words:
        out[w["k"]] = w["bits"]
    return out.tobytes()


def attribute(posts: DataFrame, keywords: DataFrame, post_id: str = "id", body: str = "text", community: str | None = None, communities: DataFrame | None = None) -> DataFrame:
    """(post_id, slug), each once: the models that posts name by a table of keywords (slug, word, tier, context), or by their community (community, slug).

    The plan serves ten keywords and a million. A keyword's words can only be met by a run of whole words of a text, so of the runs of at most as many
    words as the longest keyword has those meet the keywords in an equi-join on their letters and digits that the set of ``FEW`` keywords or a bounded filter of more lets through, and the pieces of
    text met are then held against the keyword's own pattern (hyphens and dots may be missing, or be white space). Texts are dealt out by their id, so that the texts of one large file
    are read in many tasks, and an ambiguous keyword's context words and veto find the whole text there. Signs at a keyword's ends don't count; null texts name nothing.
    """
    spark = posts.sparkSession
    own, low = F.lower("word"), F.lower(F.col(body))
    escaped = F.regexp_replace(F.regexp_replace(own, r"^[^a-z0-9_]+|[^a-z0-9_]+$", ""), r"[\^$*+?()\[\]{}|\\]", r"\\$0")
    known = keywords.select("slug", "tier", "context", own.alias("word"), F.regexp_replace(own, "[^a-z0-9_]+", "").alias("letters"), F.concat(F.lit("^(?:"), F.regexp_replace(escaped, "[-.]", r"[-\\s.]?"), F.lit(")$")).alias("pattern")).where("letters <> '' and tier is not null").distinct()
    n, longest = known.agg(F.count(F.lit(1)), F.max(F.size(F.filter(F.split("word", "[^a-z0-9_]+"), lambda w: w != "")))).first()
    few, places, longest = n <= FEW, 1 << min(24, max(16, (16 * n).bit_length())), longest or 0
    held = frozenset(r[0] for r in known.select("letters").distinct().collect()) if few else places_of(known, places)
    kind = T.StructType([T.StructField("id", posts.schema[post_id].dataType), *(T.StructField(c, T.StringType()) for c in ("letters", "piece"))])
    if spark.conf.get(BATCH_BYTES, None) is None:  # a batch of very long texts stays small
        spark.conf.set(BATCH_BYTES, "4m")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = b"" if few else np.unpackbits(np.frombuffer(held, "u1"), bitorder="little").tobytes()
        may = held.intersection if few else lambda words: {x for x in words if at[crc32(x.encode()) & (places - 1)]}
        for batch in batches:
            row, letters, piece = [], [], []
            for i, said in enumerate(batch.column(1).to_pylist()):
                for x, p in runs_met(said, longest, may):
                    row.append(i)
                    letters.append(x)
                    piece.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(letters, pa.string()), pa.array(piece, pa.string())], ["id", "letters", "piece"])

    texts = posts.where(F.col(body).isNotNull()).select(F.col(post_id).alias("id"), low.alias("text")).repartition("id")
    pieces = texts.mapInArrow(runs, kind).join(F.broadcast(known) if few else known.hint("merge"), "letters").where(F.expr("piece RLIKE pattern"))
    sure = F.col("tier") == "high"
    unless_sure = lambda c: F.when(~sure, c)
    met = pieces.select("id", F.struct("slug", sure.alias("sure"), unless_sure(F.col("context")).alias("context"), unless_sure((F.col("slug") == VETOED[0]) & F.col("word").isin(*VETOED[1])).alias("vetoed")).alias("m"))
    named = met.groupBy("id").agg(F.collect_set("m").alias("met"))
    local = text.any_of(F.col("text"), LOCAL_MODELS) & ~text.any_of(F.col("text"), EXPLICIT)
    near = lambda c: c.isNull() | F.exists(F.transform(F.split(c, ","), lambda w: F.lower(F.trim(w))), lambda w: F.col("text").contains(w))
    holds = lambda m: m["sure"] | (F.col("text").isNotNull() & near(m["context"]) & ~(m["vetoed"] & local))
    found = named.join(texts.hint("merge"), "id", "left").select("id", F.explode(F.transform(F.filter("met", holds), lambda m: m["slug"])).alias("slug"))
    if community and communities is not None:
        inside = posts.select(F.col(post_id).alias("id"), F.col(community).alias("community"))
        found = found.unionByName(inside.join(communities.select("community", "slug").hint("merge"), "community").select("id", "slug"))
    return found.distinct().select(F.col("id").alias(post_id), "slug")
