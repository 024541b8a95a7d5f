"""The driver's tables, and messages, notices and checks derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An official obligation for each order: kind by key modulo 3, deadline 30 days on, amount for payments."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("register"), F.lit("submit"), F.lit("pay")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    due = F.date_add(F.col("o_orderdate").cast("date"), 30)
    cost = (F.floor(F.col("o_totalprice") / 1000).cast("long") * 1000 + 100000)
    return o.select(
        F.col(
            "o_orderkey"
        ).alias("notice_id"), F.lit(1).cast("long").alias("version_id"), F.lit(0).alias("ordinal"), kind.alias("off_action"),
        F.date_format(due, "dd/MM/yyyy").alias("off_deadline"), F.date_format(due, "yyyy-MM-dd").alias("off_deadline_norm"), F.when(kind == "pay", cost).alias("off_amount"), due.alias("due"), cost.alias("cost"), kind.alias("kind"))


def messages_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A received message about each order's obligation, changed by key modulo 5.

    0: as it is; 1: deadline four days later; 2: amount 500000 more; 3: a
    deadline without year; 4: another action. Messages of even keys have a
    second claim that nothing can be compared of.
    """
    n = notices_of_orders(spark, sf_dir)
    way = F.col("notice_id") % 5
    day = F.when(
        way == 1, F.date_format(F.date_add("due", 4), "dd/MM/yyyy")
    ).when(way == 3, F.date_format("due", "dd/MM")).otherwise(F.col("off_deadline"))
    cost = F.col("cost") + F.when(way == 2, 500000).otherwise(0)
    verb = F.when(way == 4, "Kiểm tra kết quả").when(
        F.col("kind") == "register", "Sinh viên K21 đăng ký học phần"
    ).when(F.col("kind") == "submit", "Sinh viên nộp đơn xin xác nhận").otherwise("Đóng học phí")
    pay = F.when((F.col("kind") == "pay") & (way != 4), F.concat(F.lit(" "), F.format_string("%d", cost), F.lit(" đồng"))).otherwise("")
    text = F.concat(
        verb, pay, F.lit(" trước ngày "), day,
        F.when(F.col("notice_id") % 2 == 0, F.concat(F.lit("\n\nThông báo số "), F.col("notice_id").cast("string"))).otherwise("")
    )
    return n.select(F.col("notice_id").alias("message_id"), text.alias("text"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the user is the notice, the event type its content, clicks come by another URL."""
    e = table(spark, sf_dir, "events")
    url = F.concat(
        F.lit("https://notices.example/id/"), F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "click", "/mirror").otherwise("")
    )
    return e.select(
        F.col("event_id"), F.col("user_id").alias("notice_key"), (
            F.col("user_id") % 7
        ).alias("source_id"), url.alias("normalized_url"), F.sha2("event_type", 256).alias("content_hash"),
        F.col("ts").alias("observed_at"), F.col("props").alias("metadata"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks of sources: errors fail, sign-ups and purchases change something."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "FAILED").when(kind == "signup", "NEW").when(kind == "purchase", "UPDATED").otherwise("UNCHANGED")
    return e.select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), F.col("event_id").alias("check_id"),
        (kind == "error").alias("failed"), kind.isin("signup", "purchase").alias("changed"), F.col("props").alias("error"),
        outcome.alias("outcome"), F.col("value")
    )
