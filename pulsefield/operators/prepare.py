"""Cleaning, scaling and binning events; the dimension tables of a domain; calendar axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.config import Domain


def clean_events(df: DataFrame, check: bool = False) -> DataFrame:
    """Drops `day`, reads X, Y, T as numbers and drops rows without all three; with `check`, raises if none is left."""
    out = df.drop("day").withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in ("X", "Y", "T")}).dropna(subset=["X", "Y", "T"])
    if check and out.isEmpty():
        raise ValueError("no event has numeric X, Y and T")
    return out


def _cell(value: Column, n: int) -> Column:
    """Half-open cells; the top edge belongs to the last one. Outside values have no cell."""
    return F.when((value >= 0) & (value <= n), F.least(F.floor(value), F.lit(n - 1)).cast("int"))


def scaled_time(d: Domain, t: str = "T") -> Column:
    return F.col(t) / d.t_max * d.n_t


def season_position(d: Domain, t: str = "T") -> Column:
    """Day of the year of a time."""
    return F.pmod(F.col(t) + d.offset, F.lit(d.year))


def prepare(df: DataFrame, d: Domain) -> DataFrame:
    """point_id and further columns with u (time), x, y, a in internal units and time_bin, season_bin, cell_id."""
    u = scaled_time(d)
    a = season_position(d) / d.year * d.n_s
    x, y = (F.col("X") - d.x_min) / (d.x_max - d.x_min), (F.col("Y") - d.y_min) / (d.y_max - d.y_min)
    scaled = df.select("*", u.alias("u"), a.alias("a"), x.alias("sx"), y.alias("sy"))
    cell = _cell(F.col("sy") * d.n_xy, d.n_xy) * d.n_xy + _cell(F.col("sx") * d.n_xy, d.n_xy)
    return scaled.withColumns({"time_bin": _cell(F.col("u"), d.n_t), "season_bin": _cell(F.col("a"), d.n_s), "cell_id": cell})


def validate_season(df: DataFrame, d: Domain, check: bool = False) -> DataFrame:
    """Rows whose A differs from the derived day of year by more than a day; with `check`, raises if any does."""
    derived = season_position(d)
    bad = df.withColumn("derived", derived).filter(F.abs(F.pmod("A", F.lit(d.year)) - F.col("derived")) > 1 + 1e-5 * F.abs("derived"))
    if check and not bad.isEmpty():
        raise ValueError("A is not the day of the year of T")
    return bad


def outside(df: DataFrame) -> DataFrame:
    """Prepared rows without a time or space cell."""
    return df.filter("time_bin is null or cell_id is null")


def grid_rowcol(cell: str | Column, d: Domain) -> tuple[Column, Column]:
    """Row (from the last at the bottom up to 1) and column (from 1 at the left)."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return (d.n_xy - F.floor(c / d.n_xy)).cast("int"), (F.pmod(c, F.lit(d.n_xy)) + 1).cast("int")


def space_grid(spark: SparkSession, d: Domain) -> DataFrame:
    n, i = d.n_xy, F.col("id")
    row, col = grid_rowcol("id", d)
    low_x, low_y = (i % n) / F.lit(float(n)), F.floor(i / n) / F.lit(float(n))
    return spark.range(n * n).select(
        i.cast("int").alias("cell_id"), row.alias("grid_row"), col.alias("grid_col"), low_x.alias("x_min"), ((i % n + 1) / F.lit(float(n))).alias("x_max"), low_y.alias("y_min"), ((F.floor(i / n) + 1) / F.lit(float(n))).alias("y_max")
    )


def time_grid(spark: SparkSession, d: Domain) -> DataFrame:
    return spark.range(d.n_t).select(F.col("id").cast("int").alias("time_bin"), (F.col("id") / d.n_t * d.t_max).alias("day_from"), ((F.col("id") + 1) / d.n_t * d.t_max).alias("day_to"))


def season_grid(spark: SparkSession, d: Domain) -> DataFrame:
    return spark.range(d.n_s).select(F.col("id").cast("int").alias("season_bin"), (F.col("id") / d.n_s * d.year).alias("day_from"), ((F.col("id") + 1) / d.n_s * d.year).alias("day_to"))


def season_of_time(spark: SparkSession, d: Domain) -> DataFrame:
    """The season cell of each time cell's middle."""
    middle = (F.col("id") + 0.5) / d.n_t * d.t_max
    a = F.pmod(middle + d.offset, F.lit(d.year)) / d.year * d.n_s
    return spark.range(d.n_t).select(F.col("id").cast("int").alias("time_bin"), F.least(F.floor(a), F.lit(d.n_s - 1)).cast("int").alias("season_bin"))


def at_day(t: str | Column, origin: str) -> Column:
    """The timestamp (without zone) of a day offset."""
    t = F.col(t) if isinstance(t, str) else t
    return F.expr(f"timestamp_ntz'{origin} 00:00:00'") + F.make_dt_interval(secs=(t * 86400).cast("decimal(18,6)"))


def add_month(df: DataFrame, t_col: str, origin: str) -> DataFrame:
    return df.withColumn("month", F.month(at_day(t_col, origin)))


def to_days(u: str, d: Domain) -> Column:
    return F.col(u) / d.n_t * d.t_max


def month_ticks(spark: SparkSession, start: str, days: int, every: int = 1) -> DataFrame:
    """Month starts within `days` of `start`: date, day, label on every n-th and the last."""
    first = F.expr(f"date'{start}'")
    months = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}', 'MM'), date_add(date'{start}', {days}), interval 1 month)")).alias("tick"))
    kept = months.filter(F.col("tick") >= first).withColumn("day", F.datediff("tick", first))
    kept = kept.filter(F.col("day") <= days)
    w = Window.orderBy("tick")
    n, last = F.row_number().over(w) - 1, F.lead("tick").over(w).isNull()
    return kept.select(F.date_format("tick", "yyyy-MM-dd").alias("tick"), "day", F.when((n % every == 0) | last, F.date_format("tick", "yyyy-MM")).alias("label"))


def season_ticks(spark: SparkSession, ref_year: int, offset: float = 0.0, year: float = 365.0) -> DataFrame:
    """Month starts of a year as days of the year, shifted and wrapped."""
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.make_date(F.lit(ref_year), F.col("id").cast("int"), F.lit(1)).alias("at"))
    return months.select("month", F.pmod(F.dayofyear("at") - 1 + F.lit(offset), F.lit(year)).alias("day"))


def squared_error(df: DataFrame, a: str, b: str) -> DataFrame:
    e = F.pow(F.col(a) - F.col(b), 2)
    return df.agg(F.avg(e).alias("mse"), F.sum(e).alias("sse"))
