"""Every arm in one composite: eleven arms' verdicts, their census, the combination and the day's alerts. Their tails are special functions, which have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import combine as K
from ..operators import fullarms as A
from ..plans import conform as C
from .base import r6, red


@register("every_verdict")
def every_verdict(spark, sf_dir):
    """The verdicts of eleven arms on every settled event, as ln p; null where an arm abstains."""
    return A.every_verdict(spark, sf_dir).select("off", "ent", "detector", "status", "shadow", r6("ln_p", "ln_p"))


@register("every_verdict_census")
def every_verdict_census(spark, sf_dir):
    """By arm and status: verdicts, and those among them whose ln p is not as the status says."""
    said = F.col("status") == "evaluated"
    sound = F.coalesce(F.col("ln_p") <= 0, F.lit(False))
    return A.every_verdict(spark, sf_dir).groupBy("detector", "shadow", "status").agg(F.count("*").alias("n"), F.count_if(said != sound).alias("faults"))


@register("full_composite")
def full_composite(spark, sf_dir):
    """Fisher's combination over all arms that speak, and the arm that leads."""
    return A.combined(spark, sf_dir).select("off", "ent", "j", r6("x2", "x2"), r6("ln_p", "ln_p"), "leader")


@register("full_top_alerts")
def full_top_alerts(spark, sf_dir):
    """The twenty events of each day after burn-in with the least combined ln p over all arms; ties to earlier events."""
    c = A.combined(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("d", C.day()).withColumn("key", F.round("ln_p", 9))
    top = K.top_per_day(c, 20, ["key", "at", "ent", "off"], by=("d",))
    return top.join(C.events(spark, sf_dir).select("off", red().cast("int").alias("red")), "off").select("d", "off", "ent", "j", r6("ln_p", "ln_p"), "leader", "red")
