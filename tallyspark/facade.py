"""One object for the usual course: audit captured exchanges, watch endpoints, calibrate, report. All inputs and results are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import bpe
from tallyspark.operators import audit, calibration, exchange, likelihood, monitor, report
from tallyspark.operators import ledger as ledgers
from tallyspark.sources import files
from tallyspark.sources.store import stored
from tallyspark.streaming import endpoint


class Ledger:
    """Settings, vocabularies by model pattern, a calibration folder and a scorer, with the operators that use them.

    scorer: see operators.likelihood; None leaves noncanonical reports unresolved. scorer_name and scoring are what calibrations
    are compared by. window_path: a folder that keeps scored windows for later runs.
    """

    def __init__(
        self, spark: SparkSession, config: str | None = None, tokenizers: dict[str, str] | None = None, calibration_path: str | None = None,
        scorer: likelihood.Scorer | None = None, scorer_name: str | None = None, scoring: likelihood.Settings = likelihood.Settings(), window_path: str | None = None, **changes: object,
    ):
        self.spark, self.settings = spark, files.settings(config, **changes)
        self.tokenizers = tokenizers if tokenizers is not None else self.settings["tokenizers"]
        self.path = calibration_path or self.settings.get("calibration")
        self.scorer, self.scoring = scorer, scoring
        self.fingerprint = scoring.fingerprint(scorer_name) if scorer_name else None
        self.windows = likelihood.WindowStore(spark, window_path)

    def _choices(self, captured: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        known = files.resolved_tokenizers(audit.projected(captured).select("model"), self.tokenizers, bool(self.settings["guess_hf"]))
        # names of remote vocabularies count only where there is a way to open them
        known = known.where((F.col("origin") == "user") | F.split_part("tokenizer", F.lit(":"), F.lit(1)).isin(*bpe.OPENERS))
        c = exchange.choices_of(captured, known).withColumn("scorer", F.lit(self.fingerprint).cast("string"))
        if self.scorer is None:
            return exchange.unscored(c), None
        readings = exchange.resolved_readings(c, self.windows, self.scorer, self.scoring)
        return exchange.scored(c, readings, self.windows, self.scorer, self.scoring), readings

    def choices(self, captured: DataFrame) -> DataFrame:
        """A row for each choice of captured exchanges (`exchange` names the row), scored where a scorer is given."""
        return self._choices(captured)[0]

    def audit(self, captured: DataFrame) -> DataFrame:
        """Audited rows, judged by the calibration of each choice's key."""
        c, tables = self.choices(captured), files.read_calibration(self.spark, self.path)
        judged = exchange.verdicts(exchange.calibrated(c, tables["scores"], tables["meta"], tables["margins"], float(self.settings["alpha"])))
        return exchange.records(captured, judged)

    def outcomes(self, audited: DataFrame) -> DataFrame:
        """What the endpoint tests are fed: outcomes of the likelihood test, of the count rule where no token array came back, and
        of its full batches, each under its own key with its own p0."""
        x = self.settings
        tolerance, cols = float(x["tolerance"]), ("key", "seq", "rejected", "extra", "tokens", "p0")
        own = audit.outcomes(audited).withColumnRenamed("time", "seq").withColumn("p0", F.lit(min(float(x["alpha"]) * tolerance, 0.5)))
        if not x["count_rules"]:
            return own.select(*cols)
        gaps = files.read_calibration(self.spark, self.path)["gaps"]
        c = stored(audit.count_outcomes(audited, calibration.gap_rule(gaps)).withColumnRenamed("time", "seq"))
        requests = c.withColumns({"p0": monitor.alert_level(F.col("level"), tolerance), "extra": F.when(F.col("rejected"), F.col("extra")).otherwise(0), "key": F.concat_ws("|", F.lit("request"), "host", "key")})
        full = monitor.whole_batches(c, int(x["batch_size"]))
        batches = endpoint.batch_outcomes(full, gaps, float(x["batch_margin"]), float(x["batch_alpha"]), tolerance)
        return own.select(*cols).unionByName(requests.select(*cols)).unionByName(batches.select(*cols))

    def monitor(self, audited: DataFrame) -> DataFrame:
        """First flags of each endpoint and kind of test, in order of time."""
        return monitor.first_flags(self.outcomes(audited), float(self.settings["confidence"]), float(self.settings["min_overcharge"]))

    def thresholds(self) -> DataFrame:
        """(key, n, k, tau, warning) of the calibrated keys."""
        scores, alpha = files.read_calibration(self.spark, self.path)["scores"], float(self.settings["alpha"])
        return calibration.thresholds(scores, alpha).join(calibration.size_warnings(scores, alpha, float(self.settings["tolerance"])).select("key", "warning"), "key")

    def bounds(self, ledger: DataFrame) -> DataFrame:
        """Simultaneous upper bounds of the padding of a ledger's cells."""
        return ledgers.simultaneous_bounds(ledger)

    def integrity(self, ledger: DataFrame, expected: int = 200) -> DataFrame:
        """(check, cell, problem) of a ledger's cells."""
        return ledgers.integrity(ledger, expected)

    def control(self, ledger: DataFrame, effects: tuple[float, ...] = (0.05, 0.1, 0.28, 1.0, 5.0, 11.2)) -> DataFrame:
        """How often padding by so many percent would be found in each cell: the positive control. ledger has response_id."""
        cell = F.concat_ws("/", *ledgers.CELL).alias("cell")
        return monitor.detection_rate(ledger.select(cell, F.col("response_id").alias("id"), ledgers.delta().alias("delta"), "billed"), list(effects))

    def calibrate(self, captured: DataFrame, batch: str | None = None) -> int:
        """Adds the scores and settings of honest responses to the calibration, and raises the models' noise margins; how many
        choices it could use. The same responses again, or a batch of the same name, replace what they had added."""
        c, readings = self._choices(captured)
        c = stored(c)
        tables = files.read_calibration(self.spark, self.path)
        scores = exchange.honest_scores(c)
        key = F.concat_ws("|", "model", "language").alias("key")
        meta = tables["meta"].unionByName(c.select(key, "tokenizer", "scorer", "temperature", "top_p", "system")).distinct()
        if not calibration.conflicts(meta).isEmpty():
            raise ValueError("a key would be calibrated with different settings")
        kept = scores.count()
        if readings is not None:
            # one reading a response, and only of those that count
            usable = exchange.usable(c).where("noncanonical").select("exchange", "index")
            first = readings.where("reading = 0 and not unclear").join(usable, ["exchange", "index"])
            files.upsert_calibration("margins", likelihood.margins(first, self.windows, self.scorer, self.scoring), self.path)
        files.upsert_calibration("meta", meta, self.path)
        files.append_calibration({"scores": scores}, self.path, batch)
        return kept

    def calibrate_counts(self, audited: DataFrame, model: str | None, host: str | None, since: float | str | None = None, until: float | str | None = None, batch: str | None = None) -> DataFrame:
        """The gap rule of each key, from trusted periods: this one is added to those before. A period that is given again counts once.

        Bounds are seconds since 1970 or ISO 8601 texts; either may be open.
        """
        iso = files.period(self.spark, *(x if isinstance(x, str) else None for x in (since, until)))
        since, until = (at if x is None or isinstance(x, str) else x for x, at in zip((since, until), iso))
        gaps = calibration.gaps(calibration.trusted(audited, model, host, since, until))
        files.append_calibration({"gaps": gaps}, self.path, batch)
        return calibration.gap_rule(files.read_calibration(self.spark, self.path)["gaps"])

    def report(self, audited: DataFrame) -> DataFrame:
        return report.summary(audited)
