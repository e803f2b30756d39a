"""A synthetic corpus of reports, its sinks, and its metadata."""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import choice, uniform
from ..functions.text import FACTS, PATTERN
from .adapters import CHANNELS

# Centers, voices and the columns of a corpus row.
CENTERS = ["MOC-1", "MOC-2", "MOC-3", "MOC-4"]
VOICES = ["TERSE", "FORMAL", "NARRATIVE", "CLIPPED"]
FIELDS = ["report_id", "event_id", "report_type", "center_id", "voice", "vessel_name", "text", "sensitivity", "compartments", "capacity", "is_plant", "fact_ids"]


@dataclass(frozen=True)
class CorpusConfig:
    """What to generate; bad values are refused."""

    seed: int = 7
    n_events: int = 400
    plant_rate: float = 0.3
    centers: tuple[str, ...] = tuple(CENTERS)

    def __post_init__(self) -> None:
        if self.n_events < 1 or not 0 <= self.plant_rate <= 1 or self.seed < 0 or not self.centers:
            raise ValueError(f"not a corpus: {self}")


def fact_sets(plant: bool) -> list[tuple[int, ...]]:
    """All sets of five facts that hold the pattern, or all that hold at most two of its facts."""
    special = {FACTS.index(f) for f in PATTERN}
    return [s for s in itertools.combinations(range(len(FACTS)), 5) if special.issubset(s) == plant]


def generate(spark: SparkSession, config: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Three reports an event, each with two of its five facts so that all five are told; the same for any partitioning,
    and a smaller corpus is a prefix of a larger one. Event facts are drawn uniformly from ``fact_sets``."""
    e, s = F.col("event"), config.seed
    plant = uniform(s, e, "plant") < config.plant_rate
    # Sets are few thousand; a broadcast table keeps them out of the plan.
    table = spark.createDataFrame([(p, i, list(x)) for p in (True, False) for i, x in enumerate(fact_sets(p))], "plant boolean, i int, facts array<int>")
    n = {p: len(fact_sets(p)) for p in (True, False)}
    events = spark.range(config.n_events).withColumnRenamed("id", "event").withColumn("plant", plant)
    drawn = F.when(F.col("plant"), choice(n[True], s, e, "facts")).otherwise(choice(n[False], s, e, "facts")).cast("int")
    events = events.withColumn("i", drawn).join(F.broadcast(table), ["plant", "i"]).drop("i")
    rows = events.withColumn("slot", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    of = lambda values, index: F.get(F.array(*map(F.lit, values)), index.cast("int"))
    channel = choice(len(CHANNELS), s, e, F.col("slot"), "channel")
    ids = F.when(F.col("slot") < 2, F.slice("facts", F.col("slot") * 2 + 1, F.lit(2))).otherwise(F.slice("facts", 4, 2))
    named = F.transform(ids, lambda i: F.get(F.array(*map(F.lit, FACTS)), i))
    said = F.transform(named, lambda f: F.concat(F.replace(f, F.lit("_"), F.lit(" ")), F.lit(" at "), F.lpad(choice(24, s, e, F.col("slot"), f).cast("string"), 2, "0"), F.lit("00Z.")))
    hull = of(["tanker", "carrier", "feeder", "trawler"], choice(4, s, e, "hull"))
    mask = of([c[2] for c in CHANNELS], channel)
    # Compartment names by bit.
    comps = F.array_compact(F.array(*[F.when(mask.bitwiseAND(b) != 0, F.lit(x)) for b, x in ((4, "LEGAL"), (2, "LIAISON"), (8, "PARTNER"), (1, "SENSOR"))]))
    return rows.select(
        F.format_string("R-%05d", 3 * e + F.col("slot")).alias("report_id"), F.format_string("E-%04d", e).alias("event_id"), of([c[0] for c in CHANNELS], channel).alias("report_type"),
        of(config.centers, choice(len(config.centers), s, e, "center")).alias("center_id"), of(VOICES, choice(4, s, e, "voice")).alias("voice"), F.concat(F.lit("MV "), hull, F.lit(" "), choice(12, s, e, "vessel").cast("string")).alias("vessel_name"),
        F.concat(F.lit("Watch log, "), hull, F.lit(". "), F.array_join(said, " ")).alias("text"), of(["OPEN", "INTERNAL", "PROTECTED", "RESTRICTED"], of([c[1] for c in CHANNELS], channel)).alias("sensitivity"),
        comps.alias("compartments"), F.lit("FREETEXT").alias("capacity"), F.col("plant").alias("is_plant"), named.alias("fact_ids"),
    )


def json_lines(corpus: DataFrame) -> DataFrame:
    """One sorted-key JSON object a row."""
    return corpus.select(F.to_json(F.struct(*sorted(corpus.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(corpus: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines in order of id, as many files as needed, and returns rows and a digest of the rows' digests."""
    json_lines(corpus.repartitionByRange("report_id").sortWithinPartitions("report_id")).write.mode("overwrite").text(path)
    return digest(corpus)


def digest(corpus: DataFrame) -> DataFrame:
    """(n_rows, digest): SHA-256 over sums of the rows' hashes; the same in any order."""
    h = F.sha2(F.col("value").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return json_lines(corpus).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256).alias("digest"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(corpus: DataFrame, config: CorpusConfig) -> dict:
    """Counts by label, share of plants and a digest."""
    label = F.concat("sensitivity", F.lit("["), F.array_join("compartments", ","), F.lit("]"))
    head = corpus.agg(F.count("*").alias("n"), F.avg(F.col("is_plant").cast("double")).alias("plants")).first()
    return {"seed": config.seed, "n_events": config.n_events, "n_reports": head.n, "plant_share": head.plants, "labels": {r[0]: r[1] for r in corpus.groupBy(label.alias("k")).count().orderBy("k").collect()}, "digest": digest(corpus).first().digest}


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the files that hold a written corpus; each is hashed where it is read (2 GB at most)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def rai_block(m: dict, baseline: float | None = None, null_mean: float | None = None) -> dict[str, str]:
    """Statements on how the data came about, with the figures that a reader can check: the gate's among them."""
    told = "has not been run" if baseline is None else f"gives {baseline:.4f}" + ("" if null_mean is None else f", and {null_mean:.4f} on shuffled labels")
    return {
        "rai:dataCollection": f"Generated from seed {m['seed']} over {m['n_events']} events; nothing was collected, and the same seed gives the same rows.",
        "rai:dataCollectionType": "Synthetic; no people are described.",
        "rai:dataCollectionMissingData": "None: every field of every row is written when it is generated.",
        "rai:dataAnnotationProtocol": "Labels follow from the channel that a report came by; an event is significant if its facts hold the whole pattern.",
        "rai:dataAnnotationAnalysis": f"A probe that sees the shape of texts alone, each center held out, {told}. {m['plant_share']:.4f} of the reports are significant.",
        "rai:dataPreprocessingProtocol": "None: rows are written as they are generated, one JSON object a line.",
        "rai:dataBiases": "Texts are made of a fixed vocabulary of facts, and shapes differ by channel; judge a score against that of the probe.",
        "rai:dataUseCases": "Measuring how labels travel through triage, review and aggregation. Not for statements about real events.",
    }


def croissant(corpus: DataFrame, config: CorpusConfig, filename: str = "corpus.jsonl", folder: str | None = None, baseline: float | None = None, null_mean: float | None = None) -> str:
    """Croissant 1.0 metadata as JSON-LD, with a block on how the data came about.

    With ``folder``, where the corpus was written, each of its files is listed with its own hash, size and place; else one
    file is named, with the digest of the rows.
    """
    kinds = {"string": "sc:Text", "boolean": "sc:Boolean", "array<string>": "sc:Text"}
    m = manifest(corpus, config)
    found = [] if folder is None else files(corpus.sparkSession, folder).collect()
    shown = [{"@type": "cr:FileObject", "@id": f.name, "name": f.name, "contentUrl": f.name, "contentSize": f"{f.bytes} B", "encodingFormat": "application/jsonlines", "sha256": f.sha256} for f in found]
    shown = shown or [{"@type": "cr:FileObject", "@id": filename, "name": filename, "contentUrl": filename, "encodingFormat": "application/jsonlines", "sha256": m["digest"]}]
    source = {"fileSet": {"@id": "parts"}} if found else {"fileObject": {"@id": filename}}
    if found:
        shown.append({"@type": "cr:FileSet", "@id": "parts", "encodingFormat": "application/jsonlines", "includes": "part-*"})
    fields = [{"@type": "cr:Field", "@id": f"reports/{n}", "name": n, "dataType": kinds[t], "repeated": t.startswith("array"), "source": {**source, "extract": {"jsonPath": f"$.{n}"}}} for n, t in corpus.dtypes]
    head = {"@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "rai": "http://mlcommons.org/croissant/RAI/", "sc": "https://schema.org/"}, "@type": "sc:Dataset", "name": f"reports-{config.seed}", "conformsTo": "http://mlcommons.org/croissant/1.0"}
    return json.dumps({**head, "distribution": shown, "recordSet": [{"@type": "cr:RecordSet", "@id": "reports", "field": fields}], **rai_block(m, baseline, null_mean), "manifest": m}, indent=1)


def sha256(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
