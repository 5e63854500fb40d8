"""Detectors over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import novelty as N
from ..operators import rates as R
from ..plans import conform as C
from .base import DAY, EVENTS, HL, HOUR, ORIGIN, novelty_ctes, r6, settled_events

NOVELTY_COLUMNS = "SELECT off, ent, round(n_v, 6) AS n_v, round(n, 6) AS n, k, round(p, 6) AS p FROM x_p"


def _novelty(name, field):
    @register(name, f"WITH {EVENTS}, {novelty_ctes('x', field)} {NOVELTY_COLUMNS}")
    def run(spark, sf_dir):
        return N.dirichlet(settled_events(spark, sf_dir), field).select("off", "ent", r6("n_v", "n_v"), r6("n", "n"), "k", r6("p", "p"))


_novelty("novelty_event_type", "event_type")
_novelty("novelty_k", "k")
_novelty("novelty_band", "band")


@register("cellgrid", f"WITH {EVENTS}, {novelty_ctes('x', f'''lpad(CAST(CAST(floor(tm / {HOUR}.0) AS BIGINT) % 168 AS VARCHAR), 3, '0')''')} {NOVELTY_COLUMNS}")
def cellgrid(spark, sf_dir):
    return R.cell_grid(settled_events(spark, sf_dir)).select("off", "ent", r6("n_v", "n_v"), r6("n", "n"), "k", r6("p", "p"))


@register(
    "novelty_good_turing",
    f"""WITH {EVENTS}, {novelty_ctes('x', 'k')},
g AS (SELECT m.off, any_value(o.n) AS n, any_value(o.k) AS k, sum(CASE WHEN seen > 0 AND n_u BETWEEN 0.75 AND 1.25 THEN 1 ELSE 0 END) AS n1, max(CASE WHEN u = v AND seen > 0 THEN n_u END) AS n_v FROM x_m m JOIN x_o o USING (off) WHERE m.known GROUP BY m.off),
h AS (SELECT *, n >= 5 AND least(0.99, n1 / n) > 1.0 / (n + k + 1) AS use, 1.0 / (n + k + 1) AS plain FROM g),
i AS (SELECT *, CASE WHEN use THEN least(0.99, n1 / n) ELSE plain END AS reserve FROM h),
j AS (SELECT *, coalesce(CASE WHEN use THEN n_v * (1 - reserve) / n ELSE (n_v + 1) / (n + k + 1) END, reserve) AS observed FROM i),
t AS (SELECT j.off, sum(mass) AS s FROM (SELECT j.off, CASE WHEN use THEN n_u * (1 - reserve) / j.n ELSE (n_u + 1) / (j.n + j.k + 1) END AS mass, observed FROM x_m m JOIN j USING (off) WHERE m.known AND m.seen > 0) j WHERE mass <= observed GROUP BY j.off)
SELECT off, CAST(n1 AS BIGINT) AS n1, round(reserve, 6) AS reserve, round(CASE WHEN k = 0 THEN 1.0 ELSE least(1.0, coalesce(s, 0) + CASE WHEN reserve <= observed THEN reserve ELSE 0 END) END, 6) AS p FROM j LEFT JOIN t USING (off)""",
)
def good_turing(spark, sf_dir):
    """With a least history of 5, as these entities have."""
    return N.good_turing(settled_events(spark, sf_dir), "k", least=5.0).select("off", "n1", r6("reserve", "reserve"), r6("p", "p"))


@register(
    "pairing",
    f"""WITH {EVENTS}, {novelty_ctes('x', "event_type || chr(31) || k")}, {novelty_ctes('y', "band || chr(31) || event_type")}, {novelty_ctes('z', "band || chr(31) || k")},
a AS (SELECT off, ent, p FROM x_p UNION ALL SELECT off, ent, p FROM y_p UNION ALL SELECT off, ent, p FROM z_p)
SELECT off, any_value(ent) AS ent, count(*) AS tests, round(min(p), 6) AS min_p, round(CASE WHEN min(p) >= 1 THEN 1 ELSE 1 - pow(1 - min(p), count(*)) END, 6) AS p FROM a GROUP BY off""",
)
def pairing(spark, sf_dir):
    return N.pairing(settled_events(spark, sf_dir)).select("off", "ent", "tests", r6("min_p", "min_p"), r6("p", "p"))


@register(
    "noveltyrate",
    f"""WITH {EVENTS},
n AS (SELECT off, ent, tm, wt, CAST(floor(tm / {HOUR}.0) AS BIGINT) AS hour, CASE WHEN row_number() OVER (PARTITION BY ent, event_type ORDER BY tm, off) = 1 OR row_number() OVER (PARTITION BY ent, k ORDER BY tm, off) = 1 THEN 1 ELSE 0 END AS nov FROM e WHERE known),
h AS (SELECT ent, hour, count(*) AS t, sum(nov) AS c, lead(min(tm)) OVER (PARTITION BY ent ORDER BY hour) AS j FROM n GROUP BY ent, hour),
g AS (SELECT ent, hour, coalesce(sum(t * pow(2.0, (j - {ORIGIN}) / {float(HL)})) OVER p, 0.0) AS wt_t, coalesce(sum(c * pow(2.0, (j - {ORIGIN}) / {float(HL)})) OVER p, 0.0) AS wt_h FROM h WINDOW p AS (PARTITION BY ent ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT off, ent, CAST(sum(nov) OVER w AS BIGINT) AS k, count(*) OVER w AS m, round(wt_h / wt, 6) AS h_novel, round(wt_t / wt, 6) AS h_total, CASE WHEN wt_t / wt >= 10 THEN 'evaluated' ELSE 'abstained_structural' END AS status
FROM n JOIN g USING (ent, hour) WINDOW w AS (PARTITION BY ent, hour ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def noveltyrate(spark, sf_dir):
    """With a least history of 10 decayed events, as these entities have."""
    return N.novelty_rate(settled_events(spark, sf_dir), least=10.0).select("off", "ent", "k", "m", r6("h_novel", "h_novel"), r6("h_total", "h_total"), "status")


@register("noveltyrate_tail")
def noveltyrate_tail(spark, sf_dir):
    """Beta-binomial log tail of the hour's novel events; the special function has no SQL form."""
    from ..functions.special import beta_binomial_log_tail

    x = N.novelty_rate(settled_events(spark, sf_dir), least=10.0).where("status = 'evaluated'")
    a, b = 0.5 + F.col("h_novel"), 0.5 + F.greatest(F.lit(0.0), F.col("h_total") - F.col("h_novel"))
    return x.select("off", "ent", r6(beta_binomial_log_tail("k", "m", a, b), "log_p"))


_MOM = ", ".join(f"coalesce(sum({f}({h} * ph) * wt) OVER f, 0.0) / wt AS {f[0]}{h}" for h in (1, 2, 3) for f in ("cos", "sin"))


@register(
    "circular_moments",
    f"""WITH {EVENTS}, q AS (SELECT *, 2 * pi() * ((tm % {DAY}) + {DAY}) % {DAY} / {DAY}.0 AS ph0, 2 * pi() * (tm % {DAY}) / {DAY}.0 AS ph FROM e),
m AS (SELECT off, ent, ph, count(*) OVER f AS earlier, coalesce(sum(wt) OVER f, 0.0) / wt AS w0, {_MOM} FROM q WINDOW f AS (PARTITION BY ent ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT off, ent, earlier, round(w0, 6) AS w0, round(c1, 6) AS c1, round(s1, 6) AS s1, round(c2, 6) AS c2, round(s2, 6) AS s2, round(c3, 6) AS c3, round(s3, 6) AS s3 FROM m""",
)
def circular_moments(spark, sf_dir):
    m = R.circular_moments(C.events(spark, sf_dir), 3)
    return m.select("off", "ent", "earlier", r6("w0", "w0"), *(r6(f"{c}{h}", f"{c}{h}") for h in (1, 2, 3) for c in "cs"))


@register("timing")
def timing(spark, sf_dir):
    """Level-set mass on a 512-point grid, standardised by the entity's own past; P-values by erfc, tested against brute force."""
    from ..functions.special import normal_lower

    return R.timing(C.events(spark, sf_dir)).select("off", r6("u", "u"), r6("z", "z"), r6(normal_lower("z"), "p"), "status")


_DAYS = """days AS (SELECT ent, d, count(*) AS n FROM e GROUP BY ent, d), span AS (SELECT ent, unnest(range(min(d), max(d) + 1)) AS d FROM days GROUP BY ent),
daily AS (SELECT s.ent, s.d, coalesce(n, 0) AS n FROM span s LEFT JOIN days USING (ent, d)),
post AS (SELECT ent, d, n, 1 + coalesce(sum(n * pow(2.0, (d - 19723) / 7.0)) OVER f / pow(2.0, (d - 1 - 19723) / 7.0), 0.0) AS a, 1 + coalesce(sum(pow(2.0, (d - 19723) / 7.0)) OVER f / pow(2.0, (d - 1 - 19723) / 7.0), 0.0) AS b FROM daily
 WINDOW f AS (PARTITION BY ent ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("gamma_posterior", f"WITH {EVENTS}, {_DAYS} SELECT ent, d, n, round(a, 6) AS a, round(b, 6) AS b FROM post")
def gamma_posterior(spark, sf_dir):
    return R.gamma_posterior(C.events(spark, sf_dir)).select("ent", "d", "n", r6("a", "a"), r6("b", "b"))


_COEFFICIENTS = R.harmonics()[1]
_WAVES = ", ".join(f"sum(wt * {f}({h} * 2 * pi() * (((tm % {DAY}) + {DAY}) % {DAY}) / {DAY}.0)) AS {f[0]}{h}" for h in range(1, len(_COEFFICIENTS) + 1) for f in ("cos", "sin"))
_SHARE = " + ".join(
    f"{c!r} / ({h} * pi()) * (sum(c{h}) OVER f * (sin({h} * 2 * pi() / 24 * (hour % 24 + 1)) - sin({h} * 2 * pi() / 24 * (hour % 24))) - sum(s{h}) OVER f * (cos({h} * 2 * pi() / 24 * (hour % 24 + 1)) - cos({h} * 2 * pi() / 24 * (hour % 24)))) / sum(w) OVER f"
    for h, c in enumerate(_COEFFICIENTS, 1)
)


@register(
    "volume",
    f"""WITH {EVENTS}, {_DAYS}, hours AS (SELECT ent, CAST(floor(tm / {HOUR}.0) AS BIGINT) AS hour, count(*) AS k, sum(wt) AS w, {_WAVES} FROM e GROUP BY ALL),
sh AS (SELECT ent, hour, k, coalesce(greatest(0.0, least(1.0, CASE WHEN count(*) OVER f > 0 THEN 1.0::DOUBLE / 24 + {_SHARE} END)), 0.0) AS s0, count(*) OVER f AS earlier FROM hours WINDOW f AS (PARTITION BY ent ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT h.ent, h.hour, h.k, CASE WHEN earlier > 0 THEN s0 ELSE 1.0::DOUBLE / 24 END AS share, a / b * CASE WHEN earlier > 0 THEN s0 ELSE 1.0::DOUBLE / 24 END AS ex FROM sh h JOIN post p ON p.ent = h.ent AND p.d = h.hour // 24),
y AS (SELECT *, CASE WHEN ex > 0 THEN pow(2.0, (hour * {float(HOUR)} - {ORIGIN}) / {float(HL)}) END AS w FROM x),
z AS (SELECT *, count(w) OVER f AS c, sum(w * (k - ex) ** 2 / nullif(ex, 0)) OVER f / sum(w) OVER f AS phi FROM y WINDOW f AS (PARTITION BY ent ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ent, hour, k, round(share, 6) AS share, round(ex, 6) AS expected, round(ln(CASE WHEN c >= 5 THEN greatest(1.0, phi) END), 4) AS ln_dispersion, CASE WHEN c >= 5 OR ex <= 0 THEN 'evaluated' ELSE 'abstained_unusable' END AS status FROM z""",
)
def volume(spark, sf_dir):
    """The dispersion as its logarithm: it goes into the millions where next to nothing was expected."""
    x = R.volume(C.events(spark, sf_dir))
    return x.select("ent", "hour", "k", r6("share", "share"), r6("expected", "expected"), F.round(F.log("dispersion"), 4).alias("ln_dispersion"), "status")


@register("volume_tail")
def volume_tail(spark, sf_dir):
    """Upper tail of each hour's count: negative binomial (an incomplete beta function) where the dispersion is beyond 1, else Poisson; null where the arm abstains, 1 where nothing is expected."""
    from ..functions.special import beta_lower, gamma_log_lower

    x = R.volume(C.events(spark, sf_dir))
    k, spread, some = F.col("k").cast("double"), F.col("phi") > 1, F.col("expected") > 0
    # what the special functions are given must be sound in every row, as they are computed for all
    x = x.withColumn("phi", F.coalesce("dispersion", F.lit(1.0))).withColumn("mean", F.when(some, F.col("expected")).otherwise(1.0))
    shape = F.when(spread, F.col("mean") / (F.col("phi") - 1)).otherwise(1.0)
    p = F.when(~some, 1.0).when(spread, beta_lower(k, shape, F.col("mean") / (shape + F.col("mean")))).otherwise(F.exp(gamma_log_lower(k, F.col("mean"))))
    return x.select("ent", "hour", "k", r6(F.when(F.col("status") == "evaluated", p), "p"), "status")


@register(
    "drift",
    f"""WITH {EVENTS}, {_DAYS}, st AS (SELECT ent, d, n, CASE WHEN row_number() OVER (PARTITION BY ent ORDER BY d) = 1 THEN 0.0 ELSE n - a / b * (0.3 / ln(1.3)) END AS step FROM post),
t AS (SELECT *, sum(step) OVER (PARTITION BY ent ORDER BY d) AS total FROM st), s AS (SELECT ent, d, n, total - least(0.0, min(total) OVER (PARTITION BY ent ORDER BY d)) AS cusum FROM t),
z AS (SELECT *, avg(cusum) OVER f AS m, stddev_samp(cusum) OVER f AS sd, count(*) OVER f AS c FROM s WINDOW f AS (PARTITION BY ent ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ent, d, n, round(cusum, 6) AS cusum, round(CASE WHEN c >= 8 AND sd > 0 THEN (cusum - m) / sd END, 6) AS z, CASE WHEN c >= 8 AND sd > 0 THEN 'evaluated' ELSE 'abstained_structural' END AS status FROM z""",
)
def drift(spark, sf_dir):
    return R.drift(C.events(spark, sf_dir)).select("ent", "d", "n", r6("cusum", "cusum"), r6("z", "z"), "status")


@register("drift_tail")
def drift_tail(spark, sf_dir):
    """Upper normal tail of each day's standardised sum, and its logarithm; null where the arm abstains. erfc has no SQL form."""
    from ..functions.special import normal_upper

    x = R.drift(C.events(spark, sf_dir))
    x = x.withColumn("p", F.when(F.col("status") == "evaluated", normal_upper(F.coalesce("z", F.lit(0.0)))))
    return x.select("ent", "d", "status", r6("p", "p"), r6(F.log("p"), "ln_p"))


@register(
    "burst",
    f"""WITH {EVENTS}, i AS (SELECT DISTINCT ent, tm, wt FROM e), g AS (SELECT *, (tm - lag(tm) OVER (PARTITION BY ent ORDER BY tm)) / 1e6 AS gap FROM i),
m AS (SELECT *, count(gap) OVER f AS gaps, sum(CASE WHEN gap > 0 THEN wt END) OVER f AS wn, sum(CASE WHEN gap > 0 THEN gap * wt END) OVER f AS wg, sum(CASE WHEN gap > 0 THEN gap * gap * wt END) OVER f AS wgg, lag(tm, 2) OVER (PARTITION BY ent ORDER BY tm) AS third FROM g WINDOW f AS (PARTITION BY ent ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, wg / wn AS mu, wgg / wn - (wg / wn) * (wg / wn) AS var FROM m), s AS (SELECT *, CASE WHEN var > 0 THEN greatest(0.01, least(1.0, mu * mu / var)) ELSE 1.0 END AS kappa FROM q)
SELECT ent, tm, gaps, round(kappa, 5) AS kappa, round(mu / kappa, 3) AS theta, round(greatest(1.0, (tm - third) / 1e6), 6) AS span3, CASE WHEN gaps >= 50 THEN 'evaluated' ELSE 'abstained_structural' END AS status FROM s WHERE gaps >= 3""",
)
def burst(spark, sf_dir):
    x = R.burst(C.events(spark, sf_dir)).where("gaps >= 3")
    return x.select("ent", F.col("at").alias("tm"), "gaps", F.round("kappa", 5).alias("kappa"), F.round("theta", 3).alias("theta"), r6(F.get("spans", F.lit(0)), "span3"), "status")


@register("burst_scan")
def burst_scan(spark, sf_dir):
    """The corrected least log probability over spans of 3 to 32 instants: incomplete gamma functions."""
    return R.burst_log_p(R.burst(C.events(spark, sf_dir))).select("ent", "at", "tests", r6("log_p", "log_p"))


@register(
    "marginal_categorical",
    f"""WITH {EVENTS}, r AS (SELECT off, tm, event_type AS v, wt FROM e WHERE known), u AS (SELECT DISTINCT v AS u FROM r),
m AS (SELECT off, v, u, coalesce(sum(CASE WHEN v = u THEN wt END) OVER f, 0.0) / wt AS n_u, count(CASE WHEN v = u THEN 1 END) OVER f AS seen FROM r CROSS JOIN u WINDOW f AS (PARTITION BY u ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT off, sum(n_u) AS n, count(CASE WHEN seen > 0 THEN 1 END) AS k, coalesce(max(CASE WHEN u = v AND seen > 0 THEN n_u END), 0.0) AS n_v, max(CASE WHEN u = v AND seen > 0 THEN 1 ELSE 0 END) AS ws FROM m GROUP BY off),
t AS (SELECT m.off, sum(n_u + 1) AS s FROM m JOIN o USING (off) WHERE seen > 0 AND n_u <= n_v GROUP BY m.off)
SELECT off, round(n_v, 6) AS n_v, round(n, 6) AS n, k, CASE WHEN n >= 1000 THEN 'evaluated' ELSE 'abstained_structural' END AS status, round(CASE WHEN n >= 1000 THEN CASE WHEN ws = 0 THEN 1 / (n + k + 1) ELSE least(1.0, (coalesce(s, 0) + 1) / (n + k + 1)) END END, 6) AS p FROM o LEFT JOIN t USING (off)""",
)
def marginal_categorical(spark, sf_dir):
    return N.population(settled_events(spark, sf_dir), "event_type").select("off", r6("n_v", "n_v"), r6("n", "n"), "k", "status", r6("p", "p"))


@register(
    "cooccurrence",
    f"""WITH {EVENTS}, x AS (SELECT off, wt, coalesce(sum(wt) OVER (PARTITION BY event_type, k ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS we, coalesce(sum(wt) OVER (PARTITION BY event_type ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wa,
 coalesce(sum(wt) OVER (PARTITION BY k ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wb, coalesce(sum(wt) OVER (ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wall FROM e WHERE known)
SELECT off, round(we / wt, 6) AS w, round(wa / wt, 6) AS k_a, round(wb / wt, 6) AS k_b, round(wall / wt, 6) AS total, round(CASE WHEN wall > 0 THEN wa * wb / (2 * wall) / wt ELSE 0 END, 6) AS lam FROM x""",
)
def cooccurrence(spark, sf_dir):
    return R.cooccurrence(settled_events(spark, sf_dir)).select("off", r6("w", "w"), r6("k_a", "k_a"), r6("k_b", "k_b"), r6("total", "total"), r6("lam", "lam"))


@register("cooccurrence_tail")
def cooccurrence_tail(spark, sf_dir):
    """Poisson lower tail of the edge's weight: chi-square survival of 2 lambda with 2 (floor(w) + 1) degrees of freedom."""
    from ..functions.special import chi2_log_survival

    x = R.cooccurrence(settled_events(spark, sf_dir))
    return x.select("off", r6(F.when(F.col("lam") > 0, chi2_log_survival(2 * F.col("lam"), 2 * (F.floor("w") + 1).cast("double"))).otherwise(0.0), "log_p"))


@register(
    "decayed_counts",
    f"""WITH {EVENTS} SELECT off, ent, event_type, round(coalesce(sum(wt) OVER f, 0.0) / wt, 6) AS n, count(*) OVER f AS raw FROM e WINDOW f AS (PARTITION BY ent, event_type ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def decayed_counts(spark, sf_dir):
    own, f = C.weight(F.col("at")), C.before("ent", "event_type")
    return C.events(spark, sf_dir).select("off", "ent", "event_type", r6(F.coalesce(F.sum(own).over(f), F.lit(0.0)) / own, "n"), F.count("*").over(f).alias("raw"))


@register("population_counts", f"""WITH {EVENTS} SELECT off, event_type, CAST(count(*) OVER f AS BIGINT) AS n, round(coalesce(sum(value) OVER f, 0.0), 4) AS s FROM e WINDOW f AS (PARTITION BY event_type ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def population_counts(spark, sf_dir):
    """Two-level prefix sums of a population key, which no single task scans."""
    x = C.running(C.events(spark, sf_dir), ["event_type"], {"n": F.lit(1).cast("long"), "s": F.col("value")})
    return x.select("off", "event_type", "n", F.round("s", 4).alias("s"))
