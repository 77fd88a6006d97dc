"""ERP tables read from the star schema in ``FIXTURES.md``.

Each method is one ERP table, written as expressions over the Parquet tables. Nothing is read until a
report asks for a table, and Catalyst prunes the columns a report leaves out, so a derived table costs
no more than its used columns. Tables that need nothing of an order are not joined to the orders.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

_ROWS_PER_FILE = 2**36
# Characters of file names up to which their list is broadcast: some 500,000 files.
_PATH_BYTES = 64 << 20
_SCHEME = "^([a-z][a-z0-9+.-]*):/+"


class StarTables(Tables):
    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        super().__init__(lambda name: getattr(self, f"_{name}")())

    def _star(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self._spark.read.parquet(f"{self._root}/{name}.parquet")
        return self._read[name]

    def _values(self, columns: str, rows: str) -> DataFrame:
        """A fixed small table, known to Spark with its exact size."""
        return self._spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")

    # -- masters ---------------------------------------------------------------------------------

    def _res_company(self) -> DataFrame:
        return self._values("id, name", "(1L,'Company 1'),(2L,'Company 2'),(3L,'Company 3')")

    def _res_partner(self) -> DataFrame:
        """Customers, in families of ten under the one whose number ends in 0, and suppliers.

        Suppliers are numbered below zero, where no customer key is, however many there are.
        """
        customers = self._star("customer").selectExpr(
            "c_custkey AS id",
            "c_name AS name",
            "concat('C', c_custkey) AS vat",
            "CAST(c_nationkey AS BIGINT) AS city_id",
            "CASE WHEN c_custkey % 10 <> 0 THEN c_custkey - c_custkey % 10 END AS parent_id",
        )
        suppliers = self._star("supplier").selectExpr(
            "-1 - s_suppkey AS id",
            "s_name AS name",
            "concat('S', s_suppkey) AS vat",
            "CAST(s_nationkey AS BIGINT) AS city_id",
            "CAST(NULL AS BIGINT) AS parent_id",
        )
        return customers.unionByName(suppliers)

    def _res_city(self) -> DataFrame:
        return self._star("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name")

    def _res_users(self) -> DataFrame:
        return self._spark.range(7).selectExpr("id", "id AS partner_id")

    def _res_currency(self) -> DataFrame:
        return self._values("id, name, rounding", "(1L,'COP',0.01),(2L,'USD',0.05)")

    def _crm_team(self) -> DataFrame:
        return self._values("id, name", "(1L,'Equipo Norte'),(2L,'Equipo Centro'),(3L,'Equipo Sur')")

    def _account_account(self) -> DataFrame:
        return self._values(
            "id, code, name, ifrs_account_id",
            "(1L,'413501','Ventas A',1L),(2L,'413595','Ventas B',1L),(3L,'143501','Inventario A',3L),"
            "(4L,'143505','Inventario B',4L),(5L,'613501','Costo A',5L),(6L,'613505','Costo B',5L)",
        )

    def _account_group(self) -> DataFrame:
        return self._values(
            "id, code, name, parent_id",
            "(1L,'1','Activo',0L),(2L,'14','Inventarios',1L),(3L,'1435','Mercancias',2L),"
            "(4L,'4','Ingresos',0L),(5L,'41','Operacionales',4L),(6L,'4135','Comercio ventas',5L),"
            "(7L,'6','Costos',0L),(8L,'61','Costo de ventas',7L),(9L,'6135','Comercio costos',8L)",
        )

    def _account_journal(self) -> DataFrame:
        return self._values(
            "id, name, type",
            "(1L,'FACTURA NORTE','sale'),(2L,'COMPRAS','purchase'),(3L,'FACTURA CENTRO','sale'),"
            "(4L,'COMPRAS NC','purchase'),(5L,'DIARIO GENERAL','general')",
        )

    def _account_analytic_account(self) -> DataFrame:
        numbers = self._star("supplier").selectExpr("s_suppkey % 10 + 1 AS id").distinct()
        return numbers.selectExpr("id", "concat('AN', id) AS name")

    def _account_tax(self) -> DataFrame:
        """Plain percentages, and taxes of every kind of rule from 31 on."""
        iva = ",".join(f"({n}L,{n}.00,1L,'IVA {n}',{n},'percent',false,false,true)" for n in range(1, 9))
        others = (
            "(20L,2.50,6L,'RTE 2.5',20,'percent',false,false,true),(31L,19.00,1L,'IVA 19',10,'percent',false,false,true),"
            "(32L,19.00,1L,'IVA 19 incl',11,'percent',true,false,true),(33L,1.25,6L,'Bolsa',1,'fixed',false,true,true),"
            "(34L,8.00,6L,'Consumo',5,'percent',false,false,true),(35L,10.00,6L,'Sobre',6,'division',true,false,true),"
            "(36L,0.00,6L,'Grupo',2,'group',false,false,true),(37L,5.00,6L,'Llana',7,'percent',false,false,false)"
        )
        taxes = self._values(
            "id, amount, dian_tax_type_id, description, sequence, amount_type, price_include, include_base_amount, is_base_affected",
            f"{iva},{others}",
        )
        return taxes.withColumn("amount", F.expr("CAST(amount AS DECIMAL(9,4))"))

    def _account_tax_filiation_rel(self) -> DataFrame:
        """Members of the tax groups."""
        return self._values("parent_tax, child_tax", "(36L,31L),(36L,33L)")

    def _account_move_line_tax_mix_rel(self) -> DataFrame:
        """(line, tax): a mix of every kind of rule, by product."""
        return (
            self._numbered_lines()
            .selectExpr(
                "id AS account_move_line_id",
                """explode(CASE l_partkey % 7 WHEN 0 THEN array(31L) WHEN 1 THEN array(32L) WHEN 2 THEN array(33L, 34L)
                    WHEN 3 THEN array(35L) WHEN 4 THEN array(36L) WHEN 5 THEN array(33L, 37L) END) AS account_tax_id""",
            )
        )

    def _dian_tax_type(self) -> DataFrame:
        return self._values("id, dian_code", "(1L,'01'),(6L,'06')")

    # -- orders and entries ----------------------------------------------------------------------

    def _sale_order(self) -> DataFrame:
        return self._star("orders").selectExpr(
            "o_orderkey AS id",
            "concat('SO', o_orderkey) AS name",
            "o_custkey AS partner_id",
            "o_custkey % 7 AS user_id",
            "o_custkey % 3 + 1 AS team_id",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS amount_total",
        )

    def _sale_order_line(self) -> DataFrame:
        """Every invoice line has an order line of its own number."""
        return self._numbered_lines().selectExpr(
            "id", "l_orderkey AS order_id", "l_partkey AS product_id", f"{_SUBTOTAL} AS price_subtotal"
        )

    def _sale_order_line_invoice_rel(self) -> DataFrame:
        return (
            self._numbered_lines()
            .filter("l_orderkey % 11 <> 0")
            .selectExpr("id AS order_line_id", "id AS invoice_line_id")
        )

    def _purchase_order(self) -> DataFrame:
        bought = self["account_move"].filter("order_purchase_id IS NOT NULL")
        return bought.selectExpr("order_purchase_id AS id", "concat('PO', order_purchase_id) AS name")

    def _purchase_order_line(self) -> DataFrame:
        bought = self["account_move_line"].filter("purchase_line_id IS NOT NULL")
        return bought.selectExpr("purchase_line_id AS id", "move_id AS order_id")

    def _account_move(self) -> DataFrame:
        return self._star("orders").selectExpr(
            "o_orderkey AS id",
            """CASE WHEN o_orderstatus = 'O' AND o_orderkey % 13 = 0 THEN '/'
                    ELSE concat('AS/', lpad(CAST(o_orderkey AS STRING), 19, '0')) END AS name""",
            "concat('REF', o_orderkey % 1000) AS ref",
            "CAST(o_orderdate AS DATE) AS date",
            "CAST(o_orderdate AS DATE) AS invoice_date",
            "o_orderdate AS fe_datetime_invoice",
            "CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'cancel' END AS state",
            """CASE o_orderpriority WHEN '1-URGENT' THEN 'out_refund' WHEN '2-HIGH' THEN 'in_invoice'
                    WHEN '4-NOT SPECIFIED' THEN 'in_refund' WHEN '5-LOW' THEN 'entry'
                    ELSE 'out_invoice' END AS move_type""",
            "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS journal_id",
            """CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.92 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                    AS amount_untaxed""",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS amount_total",
            "o_custkey AS partner_id",
            "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS sale_id",
            """CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') AND o_orderkey % 5 <> 0
                    THEN o_orderkey END AS order_purchase_id""",
            "o_custkey % 7 AS invoice_user_id",
            "o_custkey % 25 AS city_id",
        )

    def _invoice_widgets(self) -> DataFrame:
        """The two JSON texts the invoice form keeps: tax totals and payments."""
        return self["account_move"].selectExpr(
            "id AS move_id",
            """CASE WHEN id % 7 = 0 THEN '{"subtotals":[],"groups_by_subtotal":{}}' ELSE concat(
                '{"subtotals":[{"name":"Base","amount":', amount_untaxed,
                '}],"groups_by_subtotal":{"Base":[{"tax_group_name":"IVA","tax_group_amount":',
                amount_total - amount_untaxed, '},{"tax_group_name":"RTE","tax_group_amount":2.5}]}}')
               END AS tax_totals_json""",
            """CASE id % 3 WHEN 0 THEN 'false' WHEN 1 THEN '{"title":"Less Payment"}'
                ELSE concat('{"content":[{"name":"', name, '","amount":', amount_total, '}]}')
               END AS invoice_payments_widget""",
        )

    def _numbered_lines(self) -> DataFrame:
        """Order lines with a row identity taken from their place in the files.

        The lines carry no key of their own. Numbering them per order would sort every order, a hot one
        in a single task; the position in the file is stable, free and needs no shuffle.
        """
        if "numbered" in self._read:
            return self._read["numbered"]
        lines = self._star("lineitem")
        files = sorted(lines.inputFiles())
        row = (
            f"IF(_metadata.row_index < {_ROWS_PER_FILE}, _metadata.row_index,"
            " raise_error(concat('too many rows in ', _metadata.file_path)))"
        )
        if len(files) == 1:
            numbered = lines.selectExpr("*", f"{row} AS id")
        else:
            scheme = re.compile(_SCHEME)
            paths = pa.array([scheme.sub(r"\1:/", path) for path in files])
            known = self._spark.createDataFrame(pa.table({"_path": paths, "_number": pa.array(range(len(files)))}))
            # One row per path, said in a way Spark knows: it drops the join where no id is used.
            known = known.groupBy("_path").agg(F.min("_number").alias("_number"))
            # The list of files is small beside the lines; within a bound it travels to them, so they aren't shuffled.
            if sum(map(len, files)) <= _PATH_BYTES:
                known = F.broadcast(known)
            numbered = (
                lines.selectExpr(
                    "*",
                    f"{row} AS _row",
                    f"regexp_replace(_metadata.file_path, '{_SCHEME}', '$1:/') AS _path",
                )
                .join(known, "_path", "left")
                .selectExpr(
                    *lines.columns,
                    "coalesce(_number, raise_error(concat('unlisted file ', _path)))"
                    f" * {_ROWS_PER_FILE} + _row AS id",
                )
            )
        self._read["numbered"] = numbered
        return numbered

    def _account_move_line(self) -> DataFrame:
        moves = self["account_move"].selectExpr(
            "id AS move_id", "partner_id AS move_partner_id", "date", "journal_id",
            "state AS parent_state", "order_purchase_id",
        )
        lines = self._numbered_lines().withColumnRenamed("l_orderkey", "move_id").join(moves, "move_id")
        lines = lines.selectExpr(
            "*",
            "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
            "l_linenumber % 2 = 0 AS even",
            "CAST(round(l_tax * 100) AS INT) AS tax",
        )
        return lines.selectExpr(
            "id",
            "move_id",
            """CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END
                 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS BIGINT) AS account_id""",
            "CASE WHEN l_linenumber % 7 <> 0 THEN move_partner_id END AS partner_id",
            "l_partkey AS product_id",
            "date",
            "journal_id",
            "parent_state",
            "move_partner_id % 3 + 1 AS company_id",
            "CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey % 10 + 1 END AS analytic_account_id",
            "CASE WHEN even THEN 1L ELSE 2L END AS currency_id",
            "concat('L', l_linenumber) AS name",
            "CASE WHEN even THEN price ELSE CAST(0 AS DECIMAL(18,2)) END AS debit",
            "CASE WHEN even THEN CAST(0 AS DECIMAL(18,2)) ELSE price END AS credit",
            "CASE WHEN even THEN price ELSE -price END AS balance",
            "CASE WHEN even THEN price ELSE -price END AS amount_currency",
            "CASE WHEN even AND l_quantity < 40 THEN price ELSE CAST(0 AS DECIMAL(18,2)) END AS ifrs_debit",
            "CASE WHEN NOT even AND l_quantity < 40 THEN price ELSE CAST(0 AS DECIMAL(18,2)) END AS ifrs_credit",
            "CASE tax WHEN 0 THEN 'local' WHEN 8 THEN 'ifrs' WHEN 7 THEN NULL ELSE 'both' END AS ifrs_type",
            f"{_QUANTITY} AS quantity",
            f"{_UNIT_PRICE} AS price_unit",
            f"{_DISCOUNT} AS discount",
            f"{_SUBTOTAL} AS price_subtotal",
            "CASE WHEN l_linenumber % 5 = 0 AND tax > 0 THEN CAST(tax AS BIGINT) END AS tax_line_id",
            "CASE WHEN order_purchase_id IS NOT NULL THEN id END AS purchase_line_id",
        )

    def _account_move_line_account_tax_rel(self) -> DataFrame:
        """(line, tax): the IVA of the line, and a withholding on discounts of 5 % and more."""
        return (
            self._numbered_lines()
            .selectExpr(
                "id AS account_move_line_id",
                """explode(array(
                    CASE WHEN round(l_tax * 100) > 0 THEN CAST(round(l_tax * 100) AS BIGINT) END,
                    CASE WHEN round(l_discount * 100) >= 5 THEN 20L END)) AS account_tax_id""",
            )
            .filter("account_tax_id IS NOT NULL")
        )

    # -- products and stock ----------------------------------------------------------------------

    def _product_product(self) -> DataFrame:
        return self._star("part").selectExpr(
            "p_partkey AS id", "p_partkey AS product_tmpl_id", "concat('P', p_partkey % 97) AS default_code"
        )

    def _product_template(self) -> DataFrame:
        return self._star("part").selectExpr(
            "p_partkey AS id",
            "p_name AS name",
            "concat('P', p_partkey % 97) AS default_code",
            "CAST(p_size AS BIGINT) AS categ_id",
            "CAST(substr(p_brand, 7) AS BIGINT) AS product_brand_id",
            "CAST(p_size % 3 + 1 AS BIGINT) AS uom_id",
            "CASE p_size % 5 WHEN 0 THEN 'consu' WHEN 1 THEN 'service' ELSE 'product' END AS detailed_type",
            "TIMESTAMP_NTZ '2000-01-01 00:00:00' + make_dt_interval(p_size) AS create_date",
        )

    def _product_category(self) -> DataFrame:
        """Sizes are categories, in five families under one root."""
        sizes = self._star("part").selectExpr("CAST(p_size AS BIGINT) AS id").distinct()
        families = sizes.selectExpr("id % 5 + 1001 AS id").distinct()
        root = self._values("id, name, parent_id", "(2000L,'Todo',CAST(NULL AS BIGINT))")
        return (
            sizes.selectExpr("id", "concat('CAT', id) AS name", "id % 5 + 1001 AS parent_id")
            .unionByName(families.selectExpr("id", "concat('FAM', id) AS name", "2000L AS parent_id"))
            .unionByName(root)
        )

    def _product_brand(self) -> DataFrame:
        brands = self._star("part").select("p_brand").distinct()
        return brands.selectExpr("CAST(substr(p_brand, 7) AS BIGINT) AS id", "p_brand AS name")

    def _uom_uom(self) -> DataFrame:
        return self._values("id, name", "(1L,'Unidad'),(2L,'Caja'),(3L,'Kilo')")

    def _ir_property(self) -> DataFrame:
        return (
            self._star("part")
            .filter("p_size % 2 = 0")
            .selectExpr("concat('product.product,', p_partkey) AS res_id", "p_retailprice AS value_float")
        )

    def _stock_valuation_layer(self) -> DataFrame:
        valued = self._star("lineitem").filter("l_returnflag <> 'A'")
        return valued.selectExpr("l_partkey AS product_id", "l_orderkey AS account_move_id")

    def _stock_location(self) -> DataFrame:
        first = self._star("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("create_date"))
        suppliers = self._star("supplier").withColumnRenamed("s_suppkey", "l_suppkey")
        return suppliers.join(first, "l_suppkey", "left").selectExpr(
            "l_suppkey AS id",
            "s_name AS name",
            "concat('WH/', s_name) AS complete_name",
            "CASE WHEN s_nationkey % 2 = 0 THEN 'internal' ELSE 'supplier' END AS usage",
            "l_suppkey % 3 + 1 AS company_id",
            "create_date",
        )

    def _stock_location_route(self) -> DataFrame:
        return self._values("id, name", "(1L,'Directo'),(2L,'Dos pasos'),(3L,'Tres pasos')")

    def _stock_warehouse(self) -> DataFrame:
        return self["stock_location"].selectExpr(
            "id",
            "concat('W-', name) AS name",
            "company_id",
            "id AS view_location_id",
            "id % 4 + 1 AS reception_route_id",
            "create_date AS write_date",
        )

    def _stock_picking(self) -> DataFrame:
        return self._star("orders").selectExpr(
            "o_orderkey AS id",
            "concat('OUT/', o_orderkey) AS name",
            "CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS partner_id",
            "o_orderdate AS scheduled_date",
            "concat('SO', o_orderkey) AS origin",
            "o_custkey % 3 + 1 AS company_id",
            "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'assigned' ELSE 'cancel' END AS state",
        )

    def _stock_quant(self) -> DataFrame:
        """Hundredths add up exactly as integers and are turned into decimals once per quant."""
        return (
            self._star("lineitem")
            .groupBy("l_partkey", "l_suppkey")
            .agg(
                F.expr(f"sum({_SIGNED_HUNDREDTHS}) AS hundredths"),
                F.expr("count_if(l_linestatus = 'O') AS reserved"),
            )
            .selectExpr(
                "l_partkey AS product_id",
                "l_suppkey AS location_id",
                "CAST(hundredths * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS quantity",
                "CAST(reserved AS DECIMAL(18,2)) AS reserved_quantity",
                "CASE WHEN (l_partkey + l_suppkey) % 4 = 0 THEN l_suppkey END AS lot_id",
            )
        )

    def _stock_production_lot(self) -> DataFrame:
        return self._star("supplier").selectExpr("s_suppkey AS id", "concat('LOT-', s_suppkey) AS name")

    def _stock_move_line(self) -> DataFrame:
        """Stock movements, positive in, negative out."""
        return self._star("lineitem").selectExpr(
            "l_partkey AS product_id",
            "l_shipdate AS date",
            "CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2)) AS quantity",
        )


_QUANTITY = "CAST(l_quantity AS DECIMAL(10,2))"
_UNIT_PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"
_DISCOUNT = "CAST(round(l_discount * 100) AS DECIMAL(5,0))"
_SUBTOTAL = f"CAST({_UNIT_PRICE} * {_QUANTITY} * (100 - {_DISCOUNT}) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,4))"
_SIGNED_HUNDREDTHS = "CAST(round(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END * 100) AS BIGINT)"
