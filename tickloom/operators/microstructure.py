"""Spreads, price impact, order-flow imbalance, tick rule and entropies."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.keys import IDX, SYMBOL, carried_sign, full, ratio, series


def _diff(c: str, order: str = IDX) -> Column:
    return F.col(c) - F.lag(c).over(series(order))


def roll_measure(bars: DataFrame, window: int) -> DataFrame:
    d = bars.withColumn("d", _diff("close")).withColumn("b", F.lag("d").over(series()))
    w = series().rowsBetween(-(window - 1), 0)
    cov = F.when(F.count("b").over(w) == window, F.covar_samp("d", "b").over(w))
    return d.withColumn("roll", 2 * F.sqrt(F.abs(cov))).withColumn("roll_impact", ratio(F.col("roll"), F.col("dollar_volume"))).drop("d", "b")


def corwin_schultz(bars: DataFrame, window: int) -> DataFrame:
    """High-low spread and the volatility that goes with it; negative estimates are 0."""
    den = 3 - 2 * math.sqrt(2)
    hl = F.pow(F.ln(F.col("high") / F.col("low")), 2)
    d = bars.withColumn("hl", hl).withColumn("two", F.col("hl") + F.lag("hl").over(series()))
    high2, low2 = F.greatest("high", F.lag("high").over(series())), F.least("low", F.lag("low").over(series()))
    d = d.withColumn("gamma", F.when(F.lag("high").over(series()).isNotNull(), F.pow(F.ln(high2 / low2), 2)))
    d = d.withColumn("beta", full(F.col("two"), F.avg, window))
    alpha = F.greatest((math.sqrt(2) - 1) * F.sqrt("beta") / den - F.sqrt(F.col("gamma") / den), F.lit(0.0))
    d = d.withColumn("alpha", F.when(F.col("beta").isNotNull() & F.col("gamma").isNotNull(), alpha))
    k2 = math.sqrt(8 / math.pi)
    sigma = (2**-0.5 - 1) * F.sqrt("beta") / (k2 * den) + F.sqrt(F.col("gamma") / (k2 * k2 * den))
    return d.withColumns({"spread_cs": 2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")), "sigma_bp": F.when(F.col("beta").isNotNull() & F.col("gamma").isNotNull(), F.greatest(sigma, F.lit(0.0)))}).drop("hl", "two", "gamma", "beta", "alpha")


def bar_lambdas(bars: DataFrame, window: int) -> DataFrame:
    """Rolling price impact by Kyle, Amihud and Hasbrouck; a price that stays keeps the last sign."""
    d = bars.withColumn("d", _diff("close")).withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(series()))
    d = d.withColumn("b", carried_sign(F.col("d"))).withColumns({"k": ratio(F.col("d"), F.col("volume") * F.col("b")), "a": ratio(F.abs("r"), F.col("dollar_volume")), "h": ratio(F.col("r"), F.col("b") * F.sqrt("dollar_volume"))})
    return d.withColumns({f"{n}_lambda": full(F.col(c), F.avg, window) for n, c in (("kyle", "k"), ("amihud", "a"), ("hasbrouck", "h"))}).drop("d", "r", "b", "k", "a", "h")


def tick_rule(ticks: DataFrame, price: str = "price", order: str = IDX) -> DataFrame:
    """1 for a buy, -1 for a sale, by the last change of price; 0 before any."""
    return ticks.withColumn("d", _diff(price, order)).withColumn("tick_rule", F.coalesce(carried_sign(F.col("d"), order), F.lit(0.0)).cast("int")).drop("d")


def trade_lambdas(ticks: DataFrame) -> DataFrame:
    """Per ``symbol, bar_id``: slopes through the origin of Kyle, Amihud and Hasbrouck with their t-statistics, volume-weighted price and mean size."""
    d = tick_rule(ticks).withColumn("dp", _diff("price")).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(series()))
    value = F.col("price") * F.col("volume")
    pairs = {"kyle": (F.col("tick_rule") * F.col("volume"), F.col("dp")), "amihud": (value, F.abs("r")), "hasbrouck": (F.col("tick_rule") * F.sqrt(value), F.abs("r"))}
    d = d.where("dp is not null").withColumns({f"{k}_{n}": e for k, (x, y) in pairs.items() for n, e in (("x", x), ("y", y))})
    aggs = [F.count("*").alias("n"), (F.sum(value) / F.sum("volume")).alias("vwap"), F.avg("volume").alias("avg_size"), F.sum("tick_rule").alias("tick_rule_sum")]
    aggs += [F.sum(F.col(f"{k}_{a}") * F.col(f"{k}_{b}")).alias(f"{k}_{a}{b}") for k in pairs for a, b in ("xx", "xy", "yy")]
    g = d.groupBy(SYMBOL, "bar_id").agg(*aggs)
    for k in pairs:
        beta = ratio(F.col(f"{k}_xy"), F.col(f"{k}_xx"))
        var = F.greatest(F.col(f"{k}_yy") - beta * F.col(f"{k}_xy"), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0)) / F.nullif(F.col(f"{k}_xx"), F.lit(0.0))
        g = g.withColumns({f"{k}_lambda": beta, f"{k}_t_stat": ratio(beta, F.sqrt(var))}).drop(f"{k}_xx", f"{k}_xy", f"{k}_yy")
    return g


def vpin(bars: DataFrame, window: int) -> DataFrame:
    """Rolling mean of the imbalance of ``buy_volume``, by volume."""
    gap = F.abs(2 * F.col("buy_volume") - F.col("volume"))
    return bars.withColumn("x", gap).withColumn("vpin", ratio(full(F.col("x"), F.avg, window), F.col("volume"))).drop("x")


def shannon_entropy(messages: DataFrame, text: str = "message") -> DataFrame:
    """Bits of the letters of each row's message, by counting letters."""
    letters = messages.select(SYMBOL, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(SYMBOL, "c").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(SYMBOL))
    return letters.withColumn("p", p).groupBy(SYMBOL).agg((-F.sum(F.col("p") * F.log2("p"))).alias("shannon"))


def plug_in_entropy(messages: DataFrame, length: int, text: str = "message") -> DataFrame:
    """Bits a letter of words of ``length``; the last word is not counted."""

    def count(batches):
        for pdf in batches:
            for symbol, m in zip(pdf[SYMBOL], pdf[text], strict=True):
                found = Counter(m[i : i + length] for i in range(len(m or "") - length))
                if found:
                    yield pd.DataFrame({SYMBOL: symbol, "code": list(found), "n": list(found.values())})

    counts = messages.select(SYMBOL, text).mapInPandas(count, f"{SYMBOL} string, code string, n long")
    return _bits(counts.groupBy(SYMBOL, "code").agg(F.sum("n").alias("n")), [SYMBOL], "plug_in").withColumn("plug_in", F.col("plug_in") / length)


def word_entropy(letters: DataFrame, length: int) -> DataFrame:
    """:func:`plug_in_entropy` of the letters ``c`` of each symbol in order, without making a message of them."""
    ahead = [F.lead("c", k).over(series()) for k in range(1, length + 1)]
    words = letters.select(SYMBOL, F.concat("c", *ahead[:-1]).alias("code"), ahead[-1].alias("next")).where("next is not null")
    return code_entropy(words, [SYMBOL], "plug_in").withColumn("plug_in", F.col("plug_in") / length)


def lempel_ziv(message: str) -> float:
    """Phrases of the incremental parse, each one letter longer than a phrase before, by length; a tree of phrases, one pass."""
    tree: list[dict[str, int]] = [{}]
    at = 0
    for letter in message:
        longer = tree[at].get(letter)
        if longer is None:
            tree[at][letter] = len(tree)
            tree.append({})
            at = 0
        else:
            at = longer
    return (len(tree) - 1) / len(message) if message else 0.0


def kontoyiannis(message: str, window: int = 0) -> float:
    """Entropy from the longest matches with what came before; an expanding window if 0."""
    n, total, points = len(message), 0.0, 0
    starts = range(1, n // 2 + 1) if window == 0 else range(min(window, n // 2), n - min(window, n // 2) + 1)
    for i in starts:
        back = i if window == 0 else min(window, n // 2)
        longest = 0
        while longest < back and i + longest < n and message.find(message[i : i + longest + 1], i - back, i + longest) != -1:
            longest += 1
        total += math.log2(back + 1) / (longest + 1)
        points += 1
    return total / points if points else 0.0


def message_entropies(messages: DataFrame, text: str = "message") -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({SYMBOL: pdf[SYMBOL], "lempel_ziv": pdf[text].map(lempel_ziv), "konto": pdf[text].map(kontoyiannis)})

    return messages.select(SYMBOL, text).mapInPandas(run, f"{SYMBOL} string, lempel_ziv double, konto double")


def tick_letters(ticks: DataFrame) -> DataFrame:
    """``symbol, bar_idx, c``: a letter a tick, b, s, or n before any."""
    c = F.when(F.col("tick_rule") > 0, "b").when(F.col("tick_rule") < 0, "s").otherwise("n")
    return tick_rule(ticks.select(SYMBOL, IDX, "price")).select(SYMBOL, IDX, c.alias("c"))


def encode_tick_rule(ticks: DataFrame) -> DataFrame:
    """The letters joined by symbol in order: one value a symbol, for short series."""
    return tick_letters(ticks).groupBy(SYMBOL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(IDX, "c"))), lambda x: x["c"]), "").alias("message"))


def quantile_codes(df: DataFrame, value: str, letters: int) -> DataFrame:
    """The number of the quantile band of each value among its symbol's."""
    cuts = df.groupBy(SYMBOL).agg(F.percentile(value, [k / letters for k in range(1, letters)]).alias("cuts"))
    return df.join(cuts, SYMBOL).withColumn("code", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def sigma_codes(df: DataFrame, value: str, step: float) -> DataFrame:
    """Bands of ``step`` from the symbol's smallest value."""
    return df.withColumn("code", F.floor((F.col(value) - F.min(value).over(Window.partitionBy(SYMBOL))) / step).cast("int"))


def nearest_codes(value: Column, levels: list[float]) -> Column:
    """The number of the level nearest to a value; of two as near, the lower."""
    gaps = F.array(*(F.struct(F.abs(value - float(x)).alias("gap"), F.lit(k).alias("code")) for k, x in enumerate(sorted(levels))))
    return F.when(value.isNotNull(), F.array_min(gaps)["code"])


def code_entropy(codes: DataFrame, by: list[str], name: str) -> DataFrame:
    """Bits of the codes within each group."""
    return _bits(codes.groupBy(*by, "code").agg(F.count("*").alias("n")), by, name)


def _bits(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))


def microstructure_matrix(ticks: DataFrame, letters: int = 4, step: float = 0.01) -> DataFrame:
    """Per ``symbol, bar_id``: impact slopes, and the entropies of trade signs, of sizes by quantile, and of returns by bands of ``step``."""
    by = [SYMBOL, "bar_id"]
    d = tick_rule(ticks).withColumn("r", F.col("price") / F.lag("price").over(series()) - 1)
    signs = code_entropy(d.withColumn("code", F.col("tick_rule")), by, "sign_entropy")
    sizes = code_entropy(quantile_codes(d, "volume", letters), by, "size_entropy")
    returns = code_entropy(sigma_codes(d.where("r is not null"), "r", step), by, "return_entropy")
    return trade_lambdas(ticks).join(signs, by).join(sizes, by).join(returns, by, "left")
