"""Retail segments: sales, products and stock moves to a per-client summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from surcos.operators.clean import pick
from surcos.operators.features import encoder_stages, varying
from surcos.operators.joins import client_totals, fan_out, fan_out_size
from surcos.operators.models import fit_holdout, segmenter
from surcos.sources.scratch import materialise

# Column names of the three tables.
SALE = ["cliente_id", "product_id", "product_uom_qty", "price_total"]
PRODUCT = ["ID", "Preciodeventa", "Cantidadamano", "Nombre"]
MOVE = {"product_id": "pid", "product_qty": "product_qty", "location_dest_id": "location_dest_id"}
ROLES = {
    "sale": "product_id",
    "product": "ID",
    "move": "pid",
    "stock": "Cantidadamano",
    "label": "Nombre",
    "moved": "product_qty",
    "target": "location_dest_id",
}
CATEGORIES = ["prod_dest", "Nombre"]
NUMERICS = ["precio_total", "prod_vendido", "stock", "prod_mov", "cantidad_compras"]


@dataclass
class Shop:
    sales: DataFrame
    products: DataFrame
    moves: DataFrame

    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return pick(self.sales, SALE), pick(self.products, PRODUCT), pick(self.moves, MOVE)


def joined(shop: Shop) -> DataFrame:
    """Every sale with its product and every move of that product."""
    keys = {k: ROLES[k] for k in ("sale", "product", "move")}
    return fan_out(*shop.parts(), **keys)


def joined_size(shop: Shop) -> DataFrame:
    """Per product, the size of :func:`joined` and its moved quantity."""
    return fan_out_size(*shop.parts(), **ROLES)


def client_summary(shop: Shop) -> DataFrame:
    """Summary of :func:`joined` per client, without building it."""
    return client_totals(
        *shop.parts(),
        client="cliente_id",
        averages={"price_total": "precio_total", "product_uom_qty": "prod_vendido"},
        **ROLES,
    )


def stages(summary: DataFrame) -> list:
    """Encoding of a client summary; a category that never varies is left out."""
    return encoder_stages(varying(summary, CATEGORIES), NUMERICS)


def segments(shop: Shop, k: int = 5) -> tuple[PipelineModel, DataFrame]:
    """The whole analysis: client summary, encoding, clusters of the test part."""
    table = materialise(client_summary(shop), "client_summary")
    return fit_holdout(table, stages(table), segmenter(k), "cliente_id")
