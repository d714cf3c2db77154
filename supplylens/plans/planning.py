"""From role tables to coverage and order plans.

Planning only needs usage per material, day and unit. That table is built and keyed once,
written, and used by every later step; it has at most one row per identity, day and
unit however often a material is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.operators import identity, inventory
from supplylens.operators.filters import filter_dates
from supplylens.session import kept


@dataclass
class RoleModel:
    """Keyed role tables; ``field`` is the identity field they were joined by."""

    field: str
    usage: DataFrame
    stock: DataFrame
    receipts: DataFrame
    orders: DataFrame
    master: DataFrame
    aliases: DataFrame
    warnings: dict[str, DataFrame]
    order: list[str]
    stock_order: list[str]
    usage_rows: DataFrame

    def audit(self) -> DataFrame:
        counts = {"receipt": self.receipts, "order": self.orders, "material_master": self.master}
        facts = inventory.join_audit(self.usage, self.stock, self.order, self.stock_order, counts,
                                     identity.ambiguous_aliases(self.usage, self.field))
        rows = self.usage_rows.agg(F.lit("usage_rows").alias("metric"), F.sum("rows").cast("bigint").alias("value"))
        return facts.where("metric != 'usage_rows'").unionByName(rows)

    def inventory(self, as_of: str, explicit: bool = True, visible: DataFrame | None = None) -> DataFrame:
        """Effective stock per material; movements come from the whole usage."""
        latest = inventory.stock_as_of(self.stock, as_of, self.stock_order, explicit)
        shown = inventory.visible_stock(latest, visible if visible is not None else self.usage)
        return inventory.effective_stock(shown, self.usage, self.receipts, as_of)

    def coverage(self, as_of: str, date_from: str | None = None) -> DataFrame:
        filtered = filter_dates(self.usage, date_from, as_of)
        return inventory.coverage(filtered, self.inventory(as_of, visible=filtered), self.order)

    def plan(self, as_of: str, season: str, **options) -> DataFrame:
        filtered = filter_dates(self.usage, None, as_of)
        stock = self.inventory(as_of, visible=filtered)
        return inventory.order_plan(filtered, stock, self.order, season, **options)


def daily_identities(usage: DataFrame, order: list[str]) -> DataFrame:
    """Usage per identity as written, day and unit: ``quantity``, ``rows`` and first ``place``."""
    names = [c for c in ("material", "material_code", "sku") if c in usage.columns]
    unit = F.col("unit") if "unit" in usage.columns else F.lit(None).cast("string")
    return usage.groupBy(*names, "date", unit.alias("unit")).agg(
        F.sum("quantity").alias("quantity"), F.count("*").alias("rows"), F.min(F.struct(*order)).alias("place"))


def build_model(usage: DataFrame, stock: DataFrame, receipts: DataFrame, orders: DataFrame,
                master: DataFrame, order: list[str], stock_order: list[str], strategy: str = "auto",
                receipt_order: list[str] | None = None, orders_order: list[str] | None = None,
                master_order: list[str] | None = None, run_date: str | None = None) -> RoleModel:
    """Resolve one material key over normalized role tables and enrich the stock."""
    daily = kept(daily_identities(usage, order))
    field = identity.resolve_join_field(daily, stock, strategy)
    aliases = kept(identity.build_alias_map(daily, field))
    keyed_usage = kept(identity.resolve_identity(daily, aliases, field))
    warnings, tables = {}, {}
    for role, table in (("receipts", receipts), ("orders", orders), ("master", master)):
        tables[role], warnings[role] = identity.attach_keys(table, aliases, field, role)
    newest = identity.latest_by_key(tables["master"], master_order or order,
                                    "date" if "date" in master.columns else None)
    open_orders = identity.order_totals(tables["orders"], orders_order or order)
    keyed_stock = kept(identity.enrich_stock(
        identity.resolve_identity(stock, aliases, field), newest, open_orders, run_date))
    return RoleModel(field, keyed_usage, keyed_stock, tables["receipts"], tables["orders"], tables["master"],
                     aliases, warnings, ["place"], stock_order, daily)
