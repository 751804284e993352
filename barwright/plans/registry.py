"""Queries of the core library, by name, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import scalar as S
from barwright.operators import blocked_fit, decide, drift, evaluate, features, fit, hmm, quality, report, resample, risk
from barwright.operators import orderflow as O
from barwright.plans import frames, oracle
from barwright.plans.frames import SAMPLE_MODEL
from barwright.sources import bars as bar_source
from barwright.sources import messages, schema
from barwright.sources.shared import new_path, stored
from barwright.streaming import flows, stateful
from barwright.streaming import ticks as tick_stream

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def r6(x: Column | str) -> Column:
    """Six places; no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> list[Column]:
    return [r6(c).alias(c) for c in columns]


@query
def f6_features(spark, d):
    rows = frames.featured(spark, d)
    return rows.select("symbol", "ts", "bar_no", *rounded(rows, *schema.FEATURES), "ready")


@query
def o0_hourly_bars(spark, d):
    return frames.bars(spark, d)


def _haloed(spark, d) -> DataFrame:
    """Bars in buckets that repeat the rows they look back on, for windows over (symbol, bucket)."""
    return features.by_halo(bar_source.numbered(frames.bars(spark, d)))


@query
def f0_log_return_z(spark, d):
    return features.window_features(_haloed(spark, d), ("symbol", "bucket")).where("not in_halo").select("symbol", "ts", r6("log_return").alias("log_return"), r6("log_return_z").alias("log_return_z"))


@query
def f1_realised_vol_z(spark, d):
    return features.window_features(_haloed(spark, d), ("symbol", "bucket")).where("not in_halo").select("symbol", "ts", r6("realised_vol").alias("realised_vol"), r6("realised_vol_z").alias("realised_vol_z"))


@query
def f5_volume_z(spark, d):
    return features.window_features(_haloed(spark, d), ("symbol", "bucket")).where("not in_halo").select("symbol", "ts", r6("volume_z").alias("volume_z"))


@query
def w1_rolling_stats(spark, d):
    by = ["symbol", "bucket"]
    rows = _haloed(spark, d).withColumns({"mean20": features.rolling_mean(F.col("close"), 20, by), "std20": features.rolling_std(F.col("close"), 20, by)})
    return rows.where("not in_halo").select("symbol", "ts", *rounded(rows, "mean20", "std20"))


@query
def w2_z_score(spark, d):
    rows = _haloed(spark, d).withColumn("z50", S.finite(features.z_score(F.col("close"), 50, ["symbol", "bucket"])))
    return rows.where("not in_halo").select("symbol", "ts", r6("z50").alias("z50"))


@query
def w3_rsi(spark, d):
    rows = features.wilder(bar_source.numbered(frames.bars(spark, d)))
    return rows.select("symbol", "ts", r6("rsi").alias("rsi"), r6((F.col("rsi") - 50) / 50).alias("rsi_deviation"))


@query
def w4_atr(spark, d):
    return features.wilder(bar_source.numbered(frames.bars(spark, d))).select("symbol", "ts", r6("atr").alias("atr"))


@query
def w5_session_vwap(spark, d):
    rows = frames.bars(spark, d).withColumn("session_id", schema.session_id(F.col("ts")))
    return features.session_vwap(rows).select("symbol", "ts", F.col("session_id").cast("string").alias("session_id"), F.round("vwap", 9).alias("vwap"))


@query
def f6_features_by_halo(spark, d):
    rows = frames.featured(spark, d, halo_rows=512)
    return rows.select("symbol", "ts", "bar_no", *rounded(rows, *schema.FEATURES), "ready")


@query
def f8_parity(spark, d):
    return features.parity(frames.featured(spark, d), frames.featured(spark, d, halo_rows=512)).select("feature", "within")


@query
def f6_features_never_reset(spark, d):
    rows = frames.featured(spark, d, session=None)
    return rows.select("symbol", "ts", r6("vwap_distance").alias("vwap_distance"))


@query
def p_scalars(spark, d):
    bars = _haloed(spark, d).withColumn("previous", F.lag("close").over(Window.partitionBy("symbol", "bucket").orderBy("bar_no"))).where("not in_halo")
    change = F.coalesce(F.col("close") - F.col("previous"), F.lit(0.0))
    return bars.select(
        "symbol", "ts", r6(S.true_range(F.col("high"), F.col("low"), F.col("previous"))).alias("true_range"), r6(S.typical_price(F.col("high"), F.col("low"), F.col("close"))).alias("typical_price"),
        r6(S.clip(change, -1, 1)).alias("clipped"), r6(S.gain(change)).alias("gain"), r6(S.loss(change)).alias("loss"),
    )


@query
def p13_percentile(spark, d):
    return frames.trades(spark, d).groupBy("account").agg(r6(F.percentile("pnl", 0.05)).alias("p5"), r6(F.percentile("pnl", 0.5)).alias("p50"), r6(F.percentile("pnl", 0.95)).alias("p95"))


@query
def p15_profile_match(spark, d):
    named = frames.table(spark, d, "orders").select("o_orderkey", F.concat(F.element_at(F.array(*(F.lit(x) for x in ("mnq ", "es ", "Crude CL ", "xx "))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("12-26")).alias("instrument"))
    return schema.match_profile(named, schema.instruments(spark)).select("o_orderkey", "profile")


@query
def s3_s4_clean_bars(spark, d):
    """Bars from text cells, some of which do not parse."""
    raw = frames.table(spark, d, "events").withColumn("bad", F.col("event_id") % 17)
    cell = lambda bad: F.when(F.col("bad") == bad, "n/a").otherwise((F.lit(100) + F.col("value")).cast("string"))
    text = raw.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.when(F.col("bad") == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        cell(1).alias("open"), cell(2).alias("high"), cell(3).alias("low"), cell(4).alias("close"), F.when(F.col("bad") == 5, "").otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("volume"),
    )
    return bar_source.cleaned(bar_source.coerced(text)).select("symbol", "seq", "ts", r6("close").alias("close"), "volume")


@query
def s1_s8_bars_from_csv(spark, d):
    """The bars written as CSV exports under names that tell the instrument, with other headers, and read back from the folder."""
    listed = F.array(*(F.lit(x) for x in schema.SYMBOLS))
    names = frames.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()
    names = names.withColumn("file", F.element_at(listed, (F.pmod(F.row_number().over(Window.orderBy("symbol")) - 1, F.lit(len(schema.SYMBOLS))) + 1).cast("int")))
    rows = frames.bars(spark, d).join(names, "symbol").select("file", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date/Time"), "open", "high", "low", F.col("close").alias("Last"), F.col("volume").alias("Vol"))
    folder = new_path(spark, "exports")
    for symbol in schema.SYMBOLS:
        rows.where(F.col("file") == symbol).drop("file").write.option("header", True).csv(f"{folder}/{symbol}_export")
    parts = [bar_source.cleaned(bar_source.read_bars_csv(spark, f"{folder}/{symbol}_export", symbol)) for symbol in schema.SYMBOLS]
    return reduce(DataFrame.unionByName, parts).select("symbol", "ts", r6("open").alias("open"), r6("close").alias("close"), "volume")


#: Headers of exports, in other orders and under other names; the columns that stand behind them.
HEADERS = [
    {"Date/Time": "ts", "open": "open", "high": "high", "low": "low", "Last": "close", "Vol": "volume"},
    {"timestamp": "ts", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"},
    {"Volume": "volume", " Close ": "close", "LOW": "low", "High": "high", "Open": "open", "note": "note", "Date": "ts"},
]


def _exports(spark, d) -> str:
    """A folder of CSV files, several for each instrument that stands for a symbol of the bars, under three headers in turn; and one file
    whose name tells no instrument."""
    rows = frames.bars(spark, d).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume", F.lit("x").alias("note"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, parts = new_path(spark, "exports"), new_path(spark, "export-parts")
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(conf)
    files.mkdirs(path(folder))
    symbols = [r.symbol for r in rows.select("symbol").distinct().orderBy("symbol").limit(len(schema.SYMBOLS)).collect()]
    for i, symbol in enumerate(symbols):
        own = rows.where(F.col("symbol") == symbol)
        columns = [F.col(c).alias(h) for h, c in HEADERS[i % 3].items()]
        own.repartition(2, "ts").select(*columns).write.option("header", True).csv(f"{parts}/{i}")
        written = sorted(s.getPath().getName() for s in files.listStatus(path(f"{parts}/{i}")) if s.getPath().getName().startswith("part-"))
        for n, name in enumerate(written):
            files.rename(path(f"{parts}/{i}/{name}"), path(f"{folder}/{schema.SYMBOLS[i].lower()} export {n}.csv"))
    rows.limit(0).select(*(F.col(c).alias(h) for h, c in HEADERS[0].items())).coalesce(1).write.option("header", True).csv(f"{parts}/none")
    for s in files.listStatus(path(f"{parts}/none")):
        if s.getPath().getName().startswith("part-"):
            files.rename(s.getPath(), path(f"{folder}/readme.csv"))
    return folder


@query
def s6_directory_of_bars(spark, d):
    """The bars written as exports of many files and three headers, and read back in one scan."""
    found = bar_source.read_directory(spark, _exports(spark, d), start="2024-01-03")
    return found.select("symbol", "ts", *rounded(found, "open", "high", "low", "close"), "volume")


@query
def s7_ingested_exports(spark, d):
    """The exports taken in as a stream, where an instrument's newest file replaces its series: what is kept, and what the quality
    checks say of it."""
    folder, table = new_path(spark, "incoming"), new_path(spark, "bars-table")
    rows = frames.bars(spark, d)
    names = rows.select("symbol").distinct().withColumn("at", F.row_number().over(Window.orderBy("symbol")) - 1)
    listed = F.array(*(F.lit(x) for x in schema.SYMBOLS))
    named = rows.join(names, "symbol").select(F.element_at(listed, (F.pmod("at", F.lit(len(schema.SYMBOLS))) + 1).cast("int")).alias("name"), "ts", "open", "high", "low", "close", "volume")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(conf)
    files.mkdirs(path(folder))
    for i, symbol in enumerate(schema.SYMBOLS):
        parts = new_path(spark, "export-parts")
        columns = [(F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if c == "ts" else F.lit("x") if c == "note" else F.col(c)).alias(h) for h, c in HEADERS[i % 3].items()]
        named.where(F.col("name") == symbol).select(*columns).coalesce(1).write.option("header", True).csv(parts)
        for s in files.listStatus(path(parts)):
            if s.getPath().getName().startswith("part-"):
                files.rename(s.getPath(), path(f"{folder}/{symbol}.csv"))
    messages.ingest_exports(spark, folder, table, new_path(spark, "ingest-checkpoint")).awaitTermination()
    kept = spark.read.parquet(table).groupBy("symbol").agg(F.count("*").alias("n_bars"), r6(F.sum("close")).alias("close"))
    warned = spark.read.parquet(f"{table}-warnings").groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "check", F.col("n").cast("string")))), ",").alias("warnings"))
    return kept.join(warned, "symbol", "left").select("symbol", "n_bars", "close", F.coalesce("warnings", F.lit("")).alias("warnings"))


@query
def s9_trades_from_text(spark, d):
    """One P&L a line, with comments and lines that are no numbers between them, written and read back."""
    path = new_path(spark, "trades")
    cents = frames.trades(spark, d).withColumn("bad", F.col("trade_id") % 11)
    line = F.when(F.col("bad") == 0, "# note").when(F.col("bad") == 1, "").when(F.col("bad") == 2, "n/a").otherwise(F.col("pnl").cast("string"))
    cents.select(line).write.text(path)
    good, bad = messages.read_trades(spark, path)
    return good.groupBy("account").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("pnl")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query
def s10_s12_model_files(spark, d):
    """Models as JSON files, some of them broken, read and validated, and the latest of each symbol from the registry."""
    sample = spark.createDataFrame([SAMPLE_MODEL], schema.MODEL)
    symbol = F.element_at(F.array(*(F.lit(x) for x in (*schema.SYMBOLS, "XX"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = frames.table(spark, d, "part").select("p_partkey", symbol.alias("symbol")).crossJoin(F.broadcast(sample.drop("symbol")))
    rows = rows.withColumn("metadata", F.col("metadata").withField("trained_at", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).drop("p_partkey")
    path, registry = new_path(spark, "models"), new_path(spark, "registry")
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(path)
    # One document a line here; a folder of one document a file is read by messages.read_models.
    sound = hmm.validated(spark.read.schema(schema.MODEL).json(path)).where("error is null").drop("error")
    messages.write_models(sound, registry)
    return messages.registry(spark, registry).select("symbol", F.col("metadata.trained_at").alias("trained_at"), "k")


@query
def s13_s14_p17_messages(spark, d):
    """Requests of the bars as JSON, single or in arrays, and what is no JSON; parsed, answered and encoded again."""
    rows = frames.bars(spark, d)
    one = F.to_json(F.struct(F.lit("infer").alias("type"), "symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.array("open", "close").alias("features")))
    text = rows.select(F.when(F.hour("ts") == 0, F.lit("oops")).when(F.hour("ts") < 6, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).otherwise(one).alias("value"))
    asked = messages.parse_requests(text)
    replies = messages.encode(asked.select("type", "symbol", F.size("features").alias("size")))
    parsed = replies.select(F.from_json("value", "type string, symbol string, size int").alias("r"))
    return parsed.groupBy(F.coalesce("r.symbol", F.lit("none")).alias("symbol")).agg(F.count("*").alias("n"), F.coalesce(F.max("r.size"), F.lit(-1)).alias("size"))


@query
def s15_ticks(spark, d):
    """Ticks of which some are not valid: how many pass, by kind."""
    rows = frames.ticks(spark, d).withColumns({"kind": F.when(F.col("seq") % 13 == 0, "?").otherwise(F.col("kind")), "price": F.when(F.col("seq") % 17 == 0, -1.0).otherwise(F.col("price"))})
    good, bad = messages.ticks_of(rows)
    return good.select("kind").unionByName(bad.select(F.lit("rejected").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query
def s5_bar_numbers(spark, d):
    return bar_source.numbered(frames.bars(spark, d)).select("symbol", "ts", "bar_no")


@query
def v_quality(spark, d):
    return quality.quality(frames.bars(spark, d))


@query
def v8_report(spark, d):
    rows = quality.report(frames.bars(spark, d))
    return rows.select("symbol", "n_bars", "clean", F.array_join("issues", ",").alias("issues"))


@query
def v9_training_status(spark, d):
    bars = frames.bars(spark, d)
    return quality.training_status(bars, features.features(bars))


@query
def m1_emissions(spark, d):
    rows = hmm.emissions(frames.featured(spark, d), SAMPLE_MODEL)
    return rows.select("symbol", "ts", *(r6(F.col("log_emission")[i]).alias(f"state_{i}") for i in range(3)))


@query
def m1_emissions_by_model_table(spark, d):
    rows = hmm.emissions_from(frames.featured(spark, d), frames.models(spark, d))
    return rows.select("symbol", "ts", *(r6(F.col("log_emission")[i]).alias(f"state_{i}") for i in range(3)))


@query
def m2_forward_filter(spark, d):
    rows = hmm.filtered(frames.featured(spark, d), SAMPLE_MODEL, block=256)
    return rows.select("symbol", "ts", *(r6(F.col("state_probs")[i]).alias(f"p{i}") for i in range(3)), "state", r6("confidence").alias("confidence"), r6("step_ll").alias("step_ll"))


@query
def m2_by_model_table(spark, d):
    """Each symbol under its own model, of two or three states; two symbols change theirs in mid-series, one model reaches the floor."""
    rows = hmm.filtered(frames.featured(spark, d), frames.versions(spark), block=128)
    p = lambda i: F.coalesce(F.try_element_at("state_probs", F.lit(i + 1)), F.lit(0.0))
    return rows.select("symbol", "ts", "model_version", *(r6(p(i)).alias(f"p{i}") for i in range(3)), "state", r6("confidence").alias("confidence"), r6("step_ll").alias("step_ll"))


@query
def m4_filter_floor(spark, d):
    """All symbols under a model whose transitions are zero: states come and go by the floor of predictions alone."""
    rows = hmm.filtered(frames.featured(spark, d), frames.LASTING, block=64)
    return rows.select("symbol", "ts", *(r6(F.col("state_probs")[i]).alias(f"p{i}") for i in range(3)), "state", r6("step_ll").alias("step_ll"))


@query
def m3_log_likelihood(spark, d):
    rows = hmm.likelihood(hmm.filtered(frames.featured(spark, d), SAMPLE_MODEL))
    return rows.select("symbol", F.round("log_likelihood", 3).alias("log_likelihood"), "n_bars")


@query
def m5_viterbi(spark, d):
    return hmm.viterbi(frames.featured(spark, d), SAMPLE_MODEL, block=256).select("symbol", "ts", "state")


@query
def m5_by_model_table(spark, d):
    return hmm.viterbi(frames.featured(spark, d), frames.versions(spark), block=128).select("symbol", "ts", "model_version", "state")


@query
def m6_trained_models(spark, d):
    """Models of every symbol, trained on its features."""
    rows = features.trainable(frames.featured(spark, d))
    return fit.models(stored(rows, "trainable"), k=3, trained_at="2026-01-01T00:00:00Z")


@query
def m6_em_step(spark, d):
    """One step of training every symbol from the sample model, in blocks: a row for each state with its new parameters."""
    blocks = blocked_fit.blocks_of(frames.featured(spark, d), ["symbol"], block=128)
    start = frames.models(spark, d).select("symbol", F.lit(0).alias("restart"), *blocked_fit.PARAMETERS)
    found = blocked_fit.em_step(blocks, start, ["symbol"], k=3, width=6)
    rows = found.select("symbol", "log_likelihood", F.posexplode(F.arrays_zip(*blocked_fit.PARAMETERS)).alias("state", "p"))
    cells = [r6("p.initial_probs").alias("initial_prob")]
    cells += [r6(F.col(f"p.{c}")[i]).alias(f"{n}_{i}") for c, n, width in (("transition_matrix", "move", 3), ("means", "mean", 6), ("variances", "variance", 6)) for i in range(width)]
    return rows.select("symbol", "state", F.round("log_likelihood", 3).alias("log_likelihood"), *cells)


@query
def m9_train_all(spark, d):
    """Every symbol with bars enough is trained, the others are told why not; whether a sound model came of it."""
    bars = frames.bars(spark, d)
    models, status = fit.train_all(bars, stored(features.features(bars), "features"))
    # The bars' symbols are not the contract's: the name of one stands for each.
    sound = hmm.validated(models.withColumns({"own": F.col("symbol"), "symbol": F.lit("NQ")})).where("error is null").select(F.col("own").alias("symbol"))
    return status.join(sound.withColumn("trained", F.lit(True)), "symbol", "left").select("symbol", "n_bars", "n_trainable", "status", F.coalesce("trained", F.lit(False)).alias("trained"))


@query
def m8_validation(spark, d):
    """Model rows of which some are broken, by symbol."""
    rows = frames.table(spark, d, "part").select("p_partkey", "p_size").crossJoin(F.broadcast(spark.createDataFrame([SAMPLE_MODEL], schema.MODEL)))
    broken = rows.withColumns(
        {
            "schema_version": F.when(F.col("p_size") == 1, 99).otherwise(F.col("schema_version")),
            "symbol": F.when(F.col("p_size") == 2, "INVALID").otherwise(F.col("symbol")),
            "initial_probs": F.when(F.col("p_size") == 3, F.slice("initial_probs", 1, 2)).otherwise(F.col("initial_probs")),
            "means": F.when(F.col("p_size") == 4, F.slice("means", 1, 2)).otherwise(F.col("means")),
            "feature_mean": F.when(F.col("p_size") == 5, F.lit(None).cast("array<double>")).otherwise(F.col("feature_mean")),
        }
    )
    return hmm.validated(broken).groupBy("error").agg(F.count("*").alias("n"))


@query
def m10_request_errors(spark, d):
    """Requests from the bars, of which some are not valid: how many of each code."""
    rows = frames.bars(spark, d)
    n = F.col("bar") % 10
    rows = rows.withColumn("bar", F.hour("ts"))
    asked = rows.select(F.when(n == 0, "unknown").otherwise("infer").alias("type"), F.when(n == 1, "ZZ").otherwise(F.col("symbol")).alias("symbol"), F.when(n == 2, F.array("open", "close")).otherwise(F.array("open", "high", "low", "close", "open", "close")).alias("features"))
    good, errors = hmm.answered(asked, frames.models(spark, d))
    return errors.groupBy("code").agg(F.count("*").alias("n")).unionByName(good.select(F.lit("OK").alias("code")).groupBy("code").agg(F.count("*").alias("n")))


@query
def m10_batch_scoring(spark, d):
    rows = hmm.response(hmm.filtered(frames.featured(spark, d), SAMPLE_MODEL))
    return rows.select("symbol", "ts", "state", "confidence")


@query
def m10_scoring_by_model_table(spark, d):
    """Responses of each symbol's own model, under the name of the version that gave them."""
    rows = hmm.filtered(frames.featured(spark, d), frames.versions(spark))
    return hmm.response(rows).select("symbol", "ts", "model_version", "state", r6("confidence").alias("confidence"))


def _scored(spark, d):
    return hmm.filtered(frames.featured(spark, d), SAMPLE_MODEL)


@query
def d2_occupancy(spark, d):
    return drift.occupancy(drift.latest(_scored(spark, d)), 3).select("symbol", r6("occupancy_drift").alias("occupancy_drift"))


@query
def d3_transition_drift(spark, d):
    return drift.transitions(drift.latest(_scored(spark, d)), frames.models(spark, d)).select("symbol", r6("transition_drift").alias("transition_drift"))


@query
def d4_likelihood_drop(spark, d):
    return drift.likelihood_drop(drift.latest(_scored(spark, d)), frames.models(spark, d)).select("symbol", r6("likelihood_drop").alias("likelihood_drop"))


@query
def d5_feature_drift(spark, d):
    return drift.feature_drift(drift.latest(frames.featured(spark, d)), frames.models(spark, d)).select("symbol", "feature", r6("drift").alias("drift"))


@query
def d7_retrain_decision(spark, d):
    rows = drift.decision(drift.metrics(_scored(spark, d), frames.models(spark, d), 3))
    return rows.select("symbol", "n", "ready", "occupancy_drift", "retrain", F.array_join("reasons", ",").alias("reasons"))


@query
def d1_rolling_drift(spark, d):
    """The measures and the decision after every bar, of the 200 bars up to it."""
    rows = drift.decision(drift.rolling_metrics(_scored(spark, d), frames.models(spark, d), 3, window=200, rows=256))
    return rows.select("symbol", "ts", "n", "ready", "occupancy_drift", "transition_drift", "likelihood_drop", "retrain", F.array_join("reasons", ",").alias("reasons"))


@query
def d8_bars_to_retrain(spark, d):
    decided = drift.decision(drift.metrics(_scored(spark, d), frames.models(spark, d), 3))
    return drift.to_retrain(decided, frames.bars(spark, d)).groupBy("symbol").agg(F.count("*").alias("n_bars"))


@query
def r1_simulations(spark, d):
    rows = resample.simulations(frames.trades(spark, d), skip_rate=0.1)
    # Sums of whole cents have no halves of a cent to round, which the decimals of round() would be for.
    cents = lambda c: (F.rint(F.col(c) * 100) / 100).alias(c)
    return rows.select("account", "sim", cents("final_pnl"), cents("max_dd"), "max_losses")


@query
def r1_simulations_with_slippage(spark, d):
    rows = resample.simulations(frames.trades(spark, d), skip_rate=0.05, slippage=20.0, seed=7, falls=False)
    return rows.select("account", "sim", F.round("final_pnl", 4).alias("final_pnl"))


@query
def r5_stress_summary(spark, d):
    rows = resample.stress(frames.trades(spark, d))
    return rows.select("account", "n_sims", *(r6(c).alias(c) for c in ("mean_pnl", "p5_pnl", "median_pnl", "p95_pnl", "mean_dd", "p5_dd", "median_dd", "p95_dd")), "max_losses", r6("pass_rate").alias("pass_rate"))


@query
def r1_few_simulations(spark, d):
    """As r1_simulations, few enough for SQL to make the same draws."""
    rows = resample.simulations(frames.trades(spark, d), n_sims=5, skip_rate=0.1)
    return rows.select("account", "sim", F.round("final_pnl", 2).alias("final_pnl"), F.round("max_dd", 2).alias("max_dd"), "max_losses")


@query
def r1_few_with_slippage(spark, d):
    rows = resample.simulations(frames.trades(spark, d), n_sims=3, skip_rate=0.05, slippage=20.0, seed=7)
    return rows.select("account", "sim", F.round("final_pnl", 4).alias("final_pnl"), F.round("max_dd", 4).alias("max_dd"), "max_losses")


@query
def r5_few_simulations(spark, d):
    rows = resample.stress(frames.trades(spark, d), n_sims=12, target=500.0, limit=400.0)
    return rows.select("account", "n_sims", *(r6(c).alias(c) for c in ("mean_pnl", "p5_pnl", "median_pnl", "p95_pnl", "mean_dd", "p5_dd", "median_dd", "p95_dd")), "max_losses", r6("pass_rate").alias("pass_rate"))


@query
def r3_max_drawdown(spark, d):
    return risk.drawdowns(frames.trades(spark, d), block=512).select("account", F.round("max_dd", 2).alias("max_dd"))


@query
def r4_losing_streak(spark, d):
    return risk.streaks(frames.trades(spark, d), block=512)


@query
def o1_prevailing_quotes(spark, d):
    return O.with_quotes(frames.ticks(spark, d)).select("symbol", "seq", "ts", "price", "bid", "ask")


@query
def o2_trade_sides(spark, d):
    return frames.sided(spark, d).select("symbol", "seq", "buy_vol", "sell_vol")


@query
def o3_bar_flow(spark, d):
    return frames.flow(spark, d).select("symbol", "ts", "buy_vol", "sell_vol", "delta", "total", r6("imbalance").alias("imbalance"))


#: A stream's micro-batches have one file more for each so many rows of the whole stream, so that more rows are more tasks.
ROWS_A_FILE = 2_000_000


def _files(rows: DataFrame, ts: str = "ts") -> tuple[DataFrame, str]:
    """A stream of the rows as files, those of some days of a month in each micro-batch, later months after earlier ones."""
    spark = rows.sparkSession
    stateful.use_rocksdb(spark)
    rows, folder = stored(rows.withColumn("__slice", F.date_format(ts, "yyyyMM").cast("int") * 10 + F.floor((F.dayofmonth(ts) - 1) / 6).cast("int")), "stream-rows"), new_path(spark, "stream-files")
    edges = rows.agg(F.percentile_approx("__slice", [0.2, 0.4, 0.6, 0.8])).first()[0] or []
    files = 4 + rows.count() // ROWS_A_FILE
    for i in range(len(edges) + 1):
        own = F.lit(True) if not i else F.col("__slice") > edges[i - 1]
        part = rows.where(own if i == len(edges) else own & (F.col("__slice") <= edges[i])).drop("__slice")
        if part.limit(1).count():
            part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(folder), folder


def _streamed(rows: DataFrame, processor, key: str = "symbol") -> DataFrame:
    """What a processor of keyed state gives for the rows as a stream."""
    spark, out = rows.sparkSession, new_path(rows.sparkSession, "stream-out")
    found = stateful.apply(_files(rows)[0], processor, key)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query
def f9_streamed_features(spark, d):
    """The features of the bars as a stream, from the state of each symbol."""
    rows = _streamed(frames.bars(spark, d), stateful.FeatureState())
    return rows.select("symbol", "ts", *rounded(rows, *schema.FEATURES), "ready")


@query
def m11_streamed_scores(spark, d):
    """The forward filter of the bars as a stream, against the latest model of each symbol."""
    asked = flows.with_latest_models(frames.featured(spark, d).select("symbol", "ts", "seq", "features"), frames.models(spark, d))
    rows = _streamed(asked, stateful.ScoreState())
    return rows.select("symbol", "ts", *(r6(F.col("state_probs")[i]).alias(f"p{i}") for i in range(3)), "state", r6("step_ll").alias("step_ll"))


@query
def t1_streamed_regimes(spark, d):
    rows = _streamed(_scored(spark, d).select("symbol", "ts", "seq", "state", "confidence", "step_ll"), stateful.HysteresisState())
    return rows.select("symbol", "ts", "regime", "flips")


@query
def d9_streamed_drift(spark, d):
    """The drift measures after every bar of a stream, and whether to train again."""
    asked = flows.with_latest_models(_scored(spark, d).select("symbol", "ts", "seq", "state", "step_ll", *schema.FEATURES), frames.models(spark, d))
    rows = _streamed(asked, stateful.DriftState(window=200))
    return rows.select("symbol", "ts", F.col("n").cast("long").alias("n"), "ready", "occupancy_drift", "transition_drift", "likelihood_drop", "retrain", "reasons")


@query
def o3_streamed_flow(spark, d):
    """The ticks as a stream of files, a few days at a time: the bars that are final four days before each symbol's last tick."""
    good, _ = messages.ticks_of(_files(frames.ticks(spark, d))[0])
    bars, late = new_path(spark, "stream-bars"), new_path(spark, "late-ticks")
    tick_stream.write_tick_flow(good, bars, late, new_path(spark, "tick-checkpoint"), lateness="96 hours").awaitTermination()
    found = spark.read.parquet(bars).select("symbol", "ts", "buy_vol", "sell_vol", r6("imbalance").alias("imbalance"))
    # A late tick would be a row of its own here, which the SQL does not have.
    return found.unionByName(spark.read.parquet(late).select("symbol", "ts", F.lit(-1.0).alias("buy_vol"), F.lit(-1.0).alias("sell_vol"), F.lit(0.0).alias("imbalance")))


@query
def o4_cumulative_delta(spark, d):
    return O.cumulative_delta(frames.flow(spark, d)).select("symbol", "ts", "cum_delta")


@query
def o5_large_orders(spark, d):
    return O.large_orders(frames.ticks(spark, d).where("kind = 'L'"))


@query
def o6_bar_proxy(spark, d):
    flow = frames.flow(spark, d).where(F.hour("ts") < 12)
    return O.bar_proxy(frames.bars(spark, d), flow).select("symbol", "ts", r6("delta").alias("delta"), r6("imbalance").alias("imbalance"))


@query
def o7_delta_z(spark, d):
    return O.delta_z(frames.flow(spark, d)).select("symbol", "ts", r6("delta_z").alias("delta_z"), "n_deltas")


@query
def o8_confirmation(spark, d):
    rows = O.delta_z(frames.flow(spark, d)).withColumn("signal", F.when(F.hour("ts") % 2 == 0, 1).otherwise(-1))
    return rows.select("symbol", "ts", "signal", O.confirmation(F.col("signal"), F.col("delta_z"), F.col("imbalance"), F.col("n_deltas"), delta_threshold=0.5).alias("confirmation"))


@query
def t1_hysteresis(spark, d):
    rows = decide.hysteresis(_scored(spark, d).select("symbol", "ts", "bar_no", "session_id", "state", "confidence"))
    return rows.select("symbol", "ts", "regime", "flips")


@query
def t2_rule_based(spark, d):
    rows = decide.rule_based(features.wilder(bar_source.numbered(frames.bars(spark, d))))
    return rows.select("symbol", "ts", F.round("sma_fast", 9).alias("sma_fast"), F.round("sma_slow", 9).alias("sma_slow"), "rule_state", "rule_signal")


@query
def t4_signals(spark, d):
    rows = _scored(spark, d).withColumnRenamed("state", "regime")
    return decide.signals(rows).select("symbol", "ts", "regime", "label", "signal")


@query
def t5_source_priority(spark, d):
    scored = _scored(spark, d)
    rules = decide.rule_based(scored).select("symbol", "bar_no", F.col("rule_state").alias("state"), F.col("rule_confidence").alias("confidence"))
    model = scored.where(F.col("bar_no") % 3 > 0).select("symbol", "bar_no", "state", "confidence")
    external = scored.where(F.col("bar_no") % 20 == 0).select("symbol", "bar_no", F.lit(1).alias("state"), F.lit(0.9).alias("confidence"))
    rows = decide.source_priority(scored.select("symbol", "ts", "bar_no"), external, model, rules)
    return rows.groupBy("symbol", "source").agg(F.count("*").alias("n"))


def _profiled(spark, d):
    """Scored bars under the instruments' names, one for each event type in turn."""
    rows = _scored(spark, d)
    # One row an event type: their number bounds this window, not the bars'.
    place = F.row_number().over(Window.orderBy("symbol")) - 1
    names = frames.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()
    listed = F.array(*(F.lit(s) for s in schema.SYMBOLS))
    named = names.select("symbol", F.element_at(listed, (F.pmod(place, F.lit(len(schema.SYMBOLS))) + 1).cast("int")).alias("__name"))
    return rows.join(named, "symbol").drop("symbol").withColumnsRenamed({"__name": "symbol", "state": "regime"})


@query
def t6_t7_stops_and_sizes(spark, d):
    rows = decide.sizes(decide.stops(_profiled(spark, d), schema.instruments(spark)))
    return rows.select("symbol", "ts", r6("stop_distance").alias("stop_distance"), r6("target_distance").alias("target_distance"), "size")


@query
def t8_mode_overrides(spark, d):
    """Bars of each instrument under the evaluation mode's thresholds."""
    rows = _profiled(spark, d).join(F.broadcast(schema.instruments(spark, "evaluation")), "symbol")
    return rows.groupBy("symbol", "confidence_threshold", "max_flips", "flatten_minutes").agg(F.count_if(F.col("confidence") >= F.col("confidence_threshold")).alias("n_confident"))


@query
def t9_session_id(spark, d):
    return frames.bars(spark, d).select("symbol", "ts", schema.session_id(F.col("ts"), "UTC", "18:00").cast("string").alias("session_id"))


@query
def t10_flatten(spark, d):
    end = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 17 HOURS")
    due = decide.flatten_due(F.col("ts"), end, F.lit(120), F.col("seq") % 2 == 0)
    return frames.ticks(spark, d).select("symbol", "seq", due.alias("flatten"))


@query
def t11_decisions(spark, d):
    scored = _scored(spark, d)
    regimes = decide.hysteresis(scored)
    flow = O.delta_z(frames.flow(spark, d)).select("symbol", "ts", "delta_z", "imbalance", "n_deltas")
    rows = decide.signals(regimes).join(flow, ["symbol", "ts"], "left")
    confirmed = O.confirmation(F.col("signal"), F.coalesce("delta_z", F.lit(0.0)), F.coalesce("imbalance", F.lit(0.0)), F.coalesce("n_deltas", F.lit(0)))
    rows = rows.withColumns({"confirmation": confirmed, "flatten": F.hour("ts") == 16, "lock": F.when(F.dayofmonth("ts") == 13, "daily"), "can_enter": F.lit(True)})
    return decide.decisions(rows).select("symbol", "ts", "gate", "action")


@query
def k1_paired_fills(spark, d):
    return risk.paired_fills(frames.fills(spark, d), schema.instruments(spark)).select("account", "symbol", "seq", F.round("pnl", 4).alias("pnl"))


@query
def k2_daily(spark, d):
    rows = risk.daily(frames.trades(spark, d))
    return rows.select("account", "trade_id", "ts", F.round("day_pnl", 2).alias("day_pnl"), "day_trades", "losses")


@query
def k3_risk_state(spark, d):
    rows = risk.risk_state(risk.daily(frames.trades(spark, d)), max_loss=20.0, profit_lock=60.0, max_trades=3, max_losses=2)
    return rows.groupBy("account", "risk_state").agg(F.count("*").alias("n"))


def _risk_events(spark, d):
    """orders as risk events of a hundred accounts, several on a day: a quarter's orders count as one day's."""
    kinds = F.array(*(F.lit(x) for x in ("signal", "entry", "exit", "entry", "exit", "signal", "stop", "entry", "exit", "clear", "exit")))
    return frames.table(spark, d, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("account"), F.date_trunc("quarter", "o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.element_at(kinds, (F.col("o_orderkey") % 11 + 1).cast("int")).alias("kind"), ((F.col("o_orderkey") % 7 - 3) * F.lit(10.0)).alias("pnl"),
    )


@query
def k4_live_state(spark, d):
    rows = risk.live_state(_risk_events(spark, d), max_loss=40.0, profit_lock=50.0, max_trades=3, max_losses=2)
    return rows.select("account", "seq", "live_state", "can_enter", "day_pnl", "day_trades", "losses")


@query
def k5_k7_evaluation(spark, d):
    rows = risk.evaluation(frames.trades(spark, d), trailing_limit=40.0, daily_limit=25.0, target=300.0)
    return rows.select("account", "trade_id", "ts", *(F.round(c, 2).alias(c) for c in ("cum_pnl", "peak", "trailing_dd")), "lock", r6("progress").alias("progress"), "target_reached")


@query
def x1_window_plan(spark, d):
    return evaluate.window_plan(bar_source.numbered(frames.bars(spark, d)), 300, 100, 100)


@query
def x2_window_assignment(spark, d):
    rows = evaluate.assign(bar_source.numbered(frames.bars(spark, d)), 300, 100, 100)
    return rows.groupBy("symbol", "window_idx", "part").agg(F.count("*").alias("n"), F.min("bar_no").alias("first"), F.max("bar_no").alias("last"))


@query
def x4_stability(spark, d):
    return evaluate.stability(_scored(spark, d)).select("symbol", r6("stability").alias("stability"))


@query
def x5_dominant_regime(spark, d):
    return evaluate.dominant(_scored(spark, d))


@query
def x7_walk_forward(spark, d):
    """Windows of the long feature series, each fitted and judged."""
    windows, _ = evaluate.walk_forward(stored(frames.featured(spark, d), "features"), train=300, test=100, step=100)
    return windows


@query
def x6_walk_forward_summary(spark, d):
    return evaluate.walk_forward(stored(frames.featured(spark, d), "features"), train=300, test=100, step=100)[1]


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Walk-forward windows under the sample model, whatever a training would have found."""
    rows = stored(frames.featured(spark, d), "features")
    assigned = evaluate.assign(rows.select("symbol", "bar_no", "features"), 90, 60, 30)
    given = evaluate.window_plan(rows, 90, 60, 30).select("symbol", "window_idx")
    sample = frames.models(spark, d).select("symbol", "initial_probs", "transition_matrix", "means", "variances", F.col("metadata.log_likelihood").alias("log_likelihood"))
    return evaluate.judged(rows, assigned, stored(given.join(sample, "symbol"), "given"), 3, 90, 60, 30)


@query
def x3_windows_of_a_given_model(spark, d):
    found = _judged(spark, d)[0]
    return found.select("symbol", "window_idx", "start", "train_end", "test_end", F.round("test_ll", 3).alias("test_ll"), r6("stability").alias("stability"), "dominant_state", "dominant_regime")


@query
def x6_summary_of_a_given_model(spark, d):
    return _judged(spark, d)[1].select("symbol", F.round("mean_test_ll", 3).alias("mean_test_ll"), r6("mean_stability").alias("mean_stability"), "n_windows")


def _log(spark, d):
    return frames.table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("event_id") % 50 == 0).alias("is_error"), (F.col("event_id") % 7).cast("double").alias("latency_ms"))


@query
def b1_model_details(spark, d):
    return report.model_details(frames.models(spark, d))


@query
def b2_transition_table(spark, d):
    return report.transition_table(frames.models(spark, d))


@query
def b3_request_counts(spark, d):
    return report.request_counts(_log(spark, d))


@query
def b4_overview(spark, d):
    names = frames.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().unionByName(schema.instruments(spark).select("symbol"))
    return report.overview(names, frames.models(spark, d).where("symbol <> 'click'"), _log(spark, d))


@query
def m12_model_status(spark, d):
    return report.status(frames.models(spark, d), _log(spark, d))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in FOUND}
