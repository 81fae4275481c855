"""Dialogue acts and price sequences from utterances, as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The price pattern and the word lists of the act cascade.
PRICE = r"(?i)(?:\$|usd\s*)?(\d+(?:\.\d{1,2})?)"
ACCEPT = ["accept", "deal", "sounds good", "you got it"]
REJECT = ["no thanks", "reject", "can't do", "too low"]
QUIT = ["bye", "nevermind", "walk away", "not interested"]
COUNTER = ["counter", "meet", "instead", "how about", "could do"]
DELIVERY = ["deliver", "delivery", "ship", "shipping"]
PICKUP = ["pickup", "pick up", "meet"]
PAYMENT = ["cash", "paypal", "venmo"]
CONCESSION = ["lower", "come down", "meet you", "split", "best i can", "final offer"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRICE), F.lit(1))


def dialogue_acts(df: DataFrame, text: str = "text") -> DataFrame:
    """Last price, act, side conditions and concession flag per utterance (Q24)."""
    low = F.lower(F.col(text))
    df = df.withColumn("offer_amount", F.try_element_at(numbers(F.col(text)), F.lit(-1)).cast("double"))
    some = F.col("offer_amount").isNotNull()
    act = (F.when(_any(low, ACCEPT), "accept").when(_any(low, REJECT), "reject").when(_any(low, QUIT), "quit")
           .when(some & _any(low, COUNTER), "counter").when(some, "propose").otherwise("other"))
    sides = F.array_compact(F.array(F.when(_any(low, DELIVERY), F.lit("delivery_or_shipping")), F.when(_any(low, PICKUP), F.lit("pickup_or_meetup")),
                                    F.when(_any(low, PAYMENT), F.lit("payment_method"))))
    return df.withColumns({"act": act, "side_conditions": sides, "concession": _any(low, CONCESSION)})


def price_sequence(df: DataFrame, conv: str, turn: str, text: str = "text") -> DataFrame:
    """Prices of each conversation with their position, one row per price, so a
    conversation of any length stays spread (Q25)."""
    from haggle.operators.ordered import done, grouped, with_row_number

    priced = dialogue_acts(df, text).filter("offer_amount IS NOT NULL").select(conv, turn, "offer_amount")
    return done(with_row_number(grouped(priced, [conv], [turn, "offer_amount"]), "position"))


def act_accuracy(df: DataFrame, text: str, label_amount: str, label_act: str) -> DataFrame:
    """Share of right prices and acts; no price on both sides is right. Also the
    texts with several numbers."""
    d = dialogue_acts(df.withColumnsRenamed({label_amount: "_la", label_act: "_lx"}), text)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("offer_amount").eqNullSafe(F.col("_la")).cast("int")).alias("offer_accuracy"),
                 F.avg((F.col("act") == F.col("_lx")).cast("int")).alias("act_accuracy"), F.count_if(F.size(numbers(F.col(text))) > 1).alias("ambiguous_rows"))
