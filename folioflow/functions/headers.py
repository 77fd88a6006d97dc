"""Header labels of the reports, kept as metadata of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The headings under which the reports show their columns.
LEDGER = {
    "code": "Code", "name": "Name", "vat": "NIT", "partner": "Partner", "date": "Date", "journal": "Journal",
    "analytic": "Account Analytic", "move": "Move", "line": "Line", "currency": "Currency", "amount": "Amount",
    "initial": "Initial", "debit": "Debit", "credit": "Credit", "final": "Final", "state": "Estado",
}
BALANCE = {
    "code": "Code", "name": "Name", "analytic_name": "Analytic Account Name", "vat": "NIT", "partner": "Partner",
    "residual": "Residual amount (balance)", "debit": "Debit", "credit": "Credit", "balance": "Balance amount",
}
AUDIT = {
    "date": "FECHA", "move": "ASIENTO", "vat": "NIT", "partner": "ASOCIADO", "account": "CUENTA", "label": "ETIQUETA",
    "debit": "DEBITO", "credit": "CREDITO", "state": "ESTADO",
}
PURCHASES = {
    "vat": "NIT", "partner": "PROVEEDOR", "purchase": "ORDEN DE COMPRA", "invoice_date": "FECHA FACTURA",
    "invoice": "FACTURA", "ref": "REF. FACTURA", "journal": "DIARIO", "default_code": "REFERENCIA INTERNA",
    "product": "PRODUCTO", "account": "CUENTA", "account_inventory": "CUENTA INVENTARIO",
    "amount_untaxed": "VALOR A. IMPUESTO", "discount": "DESCUENTO", "tax": "TARIFA IVA", "value_tax": "VALOR IVA",
    "amount_total": "VALOR TOTAL",
}
SALES = {
    "invoice_date": "Fecha", "order": "Orden de venta", "invoice": "# Factura", "analytic": "Cuenta analítica",
    "default_code": "Referencia Interna", "product": "Producto", "product_type": "Tipo de Producto",
    "category": "Categoria", "brand": "Marca", "unit": "Unidad de medida", "total_quantity": "Cantidad",
    "total_price_subtotal": "Valor", "vat": "Nit", "partner": "Cliente", "customer_city": "Ciudad Cliente",
    "invoice_city": "Ciudad Factura", "seller": "Vendedor", "team": "Equipo de ventas",
}
MARGIN = {
    "product": "Producto", "default_code": "Referencia Interna", "brand": "Marca", "quantity": "Cantidad",
    "price_subtotal": "Ingreso", "cost": "Costo", "utility": "Utilidad", "percentage_renta": "%Rentabilidad",
    "percentage_uti": "%Utilidad",
}
STOCK = {
    "product": "PRODUCTO", "default_code": "REF. PRODUCTO", "brand": "MARCA", "location": "UBICACIÓN", "lot": "LOTE",
    "category": "CATEGORÍA", "unit": "U. MEDIDA", "quantity": "CANTIDAD FISICA",
    "reserved_quantity": "CANTIDAD RESERVADA", "available_qty": "CANTIDAD DISPONIBLE",
}


def with_headers(report: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The report with the label of each column in its metadata, under ``label``; columns that aren't shown have none."""
    # One projection: a column at a time would analyse the whole plan again for each.
    columns = [(name, F.col(f"`{name}`")) for name in report.columns]
    return report.select(*[c.alias(name, metadata={"label": labels[name]}) if name in labels else c for name, c in columns])


def headers(report: DataFrame) -> dict[str, str]:
    """Labels of the columns that have one, in their order."""
    return {f.name: f.metadata["label"] for f in report.schema.fields if "label" in f.metadata}


def shown_columns(report: DataFrame) -> DataFrame:
    """The columns with a label, named by it, as a download shows them."""
    return report.select(*[F.col(f"`{name}`").alias(label) for name, label in headers(report).items()])
