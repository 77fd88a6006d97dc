"""The ERP tables as SQL views over the star schema, for checking the reports against another engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "res_company": "select * from (values (1,'Company 1'),(2,'Company 2'),(3,'Company 3')) as t(id,name)",
    "res_partner": """
        select c_custkey as id, c_name as name, concat('C', cast(c_custkey as varchar)) as vat, c_nationkey as city_id,
               case when c_custkey % 10 <> 0 then c_custkey - c_custkey % 10 end as parent_id
        from customer
        union all
        select -1 - s_suppkey, s_name, concat('S', cast(s_suppkey as varchar)), s_nationkey, null from supplier""",
    "res_city": "select n_nationkey as id, n_name as name from nation",
    "res_users": "select * from (values (0,0),(1,1),(2,2),(3,3),(4,4),(5,5),(6,6)) as t(id,partner_id)",
    "res_currency": "select * from (values (1,'COP',1),(2,'USD',5)) as t(id,name,step_cents)",
    "crm_team": "select * from (values (1,'Equipo Norte'),(2,'Equipo Centro'),(3,'Equipo Sur')) as t(id,name)",
    "account_account": """
        select * from (values (1,'413501','Ventas A',1),(2,'413595','Ventas B',1),(3,'143501','Inventario A',3),
        (4,'143505','Inventario B',4),(5,'613501','Costo A',5),(6,'613505','Costo B',5)) as t(id,code,name,ifrs_account_id)""",
    "account_group": """
        select * from (values (1,'1','Activo',0),(2,'14','Inventarios',1),(3,'1435','Mercancias',2),(4,'4','Ingresos',0),
        (5,'41','Operacionales',4),(6,'4135','Comercio ventas',5),(7,'6','Costos',0),(8,'61','Costo de ventas',7),
        (9,'6135','Comercio costos',8)) as t(id,code,name,parent_id)""",
    "account_journal": """
        select * from (values (1,'FACTURA NORTE','sale'),(2,'COMPRAS','purchase'),(3,'FACTURA CENTRO','sale'),
        (4,'COMPRAS NC','purchase'),(5,'DIARIO GENERAL','general')) as t(id,name,type)""",
    "account_analytic_account": """
        select distinct s_suppkey % 10 + 1 as id, concat('AN', cast(s_suppkey % 10 + 1 as varchar)) as name from supplier""",
    "account_tax": """
        select id, cast(amount as decimal(9,4)) as amount, dian_tax_type_id, description from (values
        (1,1.0,1,'IVA 1'),(2,2.0,1,'IVA 2'),(3,3.0,1,'IVA 3'),(4,4.0,1,'IVA 4'),(5,5.0,1,'IVA 5'),(6,6.0,1,'IVA 6'),
        (7,7.0,1,'IVA 7'),(8,8.0,1,'IVA 8'),(20,2.5,6,'RTE 2.5')) as t(id,amount,dian_tax_type_id,description)""",
    "dian_tax_type": "select * from (values (1,'01'),(6,'06')) as t(id,dian_code)",
    "sale_order": """
        select o_orderkey as id, concat('SO', cast(o_orderkey as varchar)) as name, o_custkey as partner_id,
               o_custkey % 7 as user_id, o_custkey % 3 + 1 as team_id, cast(o_totalprice as decimal(18,2)) as amount_total
        from orders""",
    "account_move": """
        select o_orderkey as id,
               case when o_orderstatus = 'O' and o_orderkey % 13 = 0 then '/'
                    else concat('AS/', lpad(cast(o_orderkey as varchar), 19, '0')) end as name,
               concat('REF', cast(o_orderkey % 1000 as varchar)) as ref,
               cast(o_orderdate as date) as date, cast(o_orderdate as date) as invoice_date,
               o_orderdate as fe_datetime_invoice,
               case o_orderstatus when 'F' then 'posted' when 'O' then 'draft' else 'cancel' end as state,
               case o_orderpriority when '1-URGENT' then 'out_refund' when '2-HIGH' then 'in_invoice'
                    when '4-NOT SPECIFIED' then 'in_refund' when '5-LOW' then 'entry' else 'out_invoice' end as move_type,
               cast(substr(o_orderpriority, 1, 1) as bigint) as journal_id,
               cast(cast(o_totalprice as decimal(18,2)) * cast(0.92 as decimal(3,2)) as decimal(18,2)) as amount_untaxed,
               cast(o_totalprice as decimal(18,2)) as amount_total, o_custkey as partner_id,
               case when o_orderkey % 11 = 0 then null else o_orderkey end as sale_id,
               case when o_orderpriority in ('2-HIGH', '4-NOT SPECIFIED') and o_orderkey % 5 <> 0 then o_orderkey end
                    as order_purchase_id,
               o_custkey % 7 as invoice_user_id, o_custkey % 25 as city_id
        from orders""",
    "purchase_order": """
        select id, concat('PO', cast(id as varchar)) as name from account_move where order_purchase_id is not null""",
    "account_move_line": """
        select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                   l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id,
               l_orderkey as move_id,
               cast(case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end
                    + case l_linestatus when 'F' then 1 else 2 end as bigint) as account_id,
               case when l_linenumber % 7 = 0 then null else m.partner_id end as partner_id, l_partkey as product_id,
               m.date as date, m.journal_id as journal_id, m.state as parent_state, m.partner_id % 3 + 1 as company_id,
               case when l_linenumber % 3 = 0 then null else l_suppkey % 10 + 1 end as analytic_account_id,
               case when l_linenumber % 2 = 0 then 1 else 2 end as currency_id,
               concat('L', cast(l_linenumber as varchar)) as name,
               cast(case when l_linenumber % 2 = 0 then l_extendedprice else 0 end as decimal(18,2)) as debit,
               cast(case when l_linenumber % 2 = 1 then l_extendedprice else 0 end as decimal(18,2)) as credit,
               cast(case when l_linenumber % 2 = 0 then l_extendedprice else -l_extendedprice end as decimal(18,2)) as balance,
               cast(case when l_linenumber % 2 = 0 then l_extendedprice else -l_extendedprice end as decimal(18,2))
                   as amount_currency,
               cast(case when l_linenumber % 2 = 0 and l_quantity < 40 then l_extendedprice else 0 end as decimal(18,2))
                   as ifrs_debit,
               cast(case when l_linenumber % 2 = 1 and l_quantity < 40 then l_extendedprice else 0 end as decimal(18,2))
                   as ifrs_credit,
               case cast(round(l_tax * 100) as int) when 0 then 'local' when 8 then 'ifrs' when 7 then null else 'both' end
                   as ifrs_type,
               cast(l_quantity as decimal(10,2)) as quantity, cast(l_extendedprice as decimal(14,2)) as price_unit,
               cast(round(l_discount * 100) as int) as discount,
               cast(cast(l_extendedprice as decimal(14,2)) * cast(l_quantity as decimal(10,2))
                   * cast(100 - cast(round(l_discount * 100) as int) as decimal(5,0)) * cast(0.01 as decimal(3,2))
                   as decimal(18,4)) as price_subtotal,
               cast(round(l_tax * 100) as bigint) as iva_pct,
               case when l_linenumber % 5 = 0 and round(l_tax * 100) > 0 then cast(round(l_tax * 100) as bigint) end
                   as tax_line_id,
               m.order_purchase_id as line_purchase_id
        from lineitem join account_move m on m.id = l_orderkey""",
    "account_move_line_account_tax_rel": """
        select id as account_move_line_id, iva_pct as account_tax_id from account_move_line where iva_pct > 0
        union all select id, 20 from account_move_line where discount >= 5""",
    "product_product": """
        select p_partkey as id, p_partkey as product_tmpl_id, concat('P', cast(p_partkey % 97 as varchar)) as default_code
        from part""",
    "product_template": """
        select p_partkey as id, p_name as name, concat('P', cast(p_partkey % 97 as varchar)) as default_code,
               cast(p_size as bigint) as categ_id, cast(substr(p_brand, 7) as bigint) as product_brand_id,
               cast(p_size % 3 + 1 as bigint) as uom_id,
               case when p_size % 5 = 0 then 'consu' when p_size % 5 = 1 then 'service' else 'product' end as detailed_type,
               timestamp '2000-01-01' + to_days(p_size) as create_date
        from part""",
    "product_category": """
        select distinct cast(p_size as bigint) as id, concat('CAT', cast(p_size as varchar)) as name,
               cast(p_size % 5 + 1001 as bigint) as parent_id from part
        union all
        select distinct cast(p_size % 5 + 1001 as bigint), concat('FAM', cast(p_size % 5 + 1001 as varchar)),
               cast(2000 as bigint) from part
        union all select cast(2000 as bigint), 'Todo', null""",
    "product_brand": "select distinct cast(substr(p_brand, 7) as bigint) as id, p_brand as name from part",
    "uom_uom": "select * from (values (1,'Unidad'),(2,'Caja'),(3,'Kilo')) as t(id,name)",
    "ir_property": """
        select concat('product.product,', cast(p_partkey as varchar)) as res_id, p_retailprice as value_float
        from part where p_size % 2 = 0""",
    "stock_valuation_layer": """
        select product_id, move_id as account_move_id from account_move_line where account_id in (3,4,5,6)""",
    "stock_location": """
        select s_suppkey as id, s_name as name, concat('WH/', s_name) as complete_name,
               case when s_nationkey % 2 = 0 then 'internal' else 'supplier' end as usage, s_suppkey % 3 + 1 as company_id,
               x.first_ship as create_date
        from supplier left join (select l_suppkey, min(l_shipdate) as first_ship from lineitem group by l_suppkey) x
             on x.l_suppkey = s_suppkey""",
    "stock_location_route": "select * from (values (1,'Directo'),(2,'Dos pasos'),(3,'Tres pasos')) as t(id,name)",
    "stock_warehouse": """
        select id, concat('W-', name) as name, company_id, id as view_location_id, id % 4 + 1 as reception_route_id,
               create_date as write_date from stock_location""",
    "stock_picking": """
        select o_orderkey as id, concat('OUT/', cast(o_orderkey as varchar)) as name,
               case when o_custkey % 9 = 0 then null else o_custkey end as partner_id, o_orderdate as scheduled_date,
               concat('SO', cast(o_orderkey as varchar)) as origin, o_custkey % 3 + 1 as company_id,
               case o_orderstatus when 'F' then 'done' when 'O' then 'assigned' else 'cancel' end as state
        from orders""",
    "stock_quant": """
        select l_partkey as product_id, l_suppkey as location_id,
               cast(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as decimal(18,2)) as quantity,
               cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as decimal(18,2)) as reserved_quantity,
               case when (l_partkey + l_suppkey) % 4 = 0 then l_suppkey end as lot_id
        from lineitem group by l_partkey, l_suppkey""",
    "stock_production_lot": "select s_suppkey as id, concat('LOT-', cast(s_suppkey as varchar)) as name from supplier",
    "stock_move_line": """
        select l_partkey as product_id, l_shipdate as date,
               cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as decimal(18,2)) as quantity
        from lineitem""",
    "sale_order_line": "select id, move_id as order_id, product_id, price_subtotal from account_move_line",
    "sale_order_line_invoice_rel": """
        select id as order_line_id, id as invoice_line_id from account_move_line where move_id % 11 <> 0""",
    "purchase_order_line": """
        select id, move_id as order_id from account_move_line where line_purchase_id is not null""",
    "invoice_widgets": """
        select id as move_id,
               case when id % 7 = 0 then '{"subtotals":[],"groups_by_subtotal":{}}'
                    else concat('{"subtotals":[{"name":"Base","amount":', cast(amount_untaxed as varchar),
                        '}],"groups_by_subtotal":{"Base":[{"tax_group_name":"IVA","tax_group_amount":',
                        cast(amount_total - amount_untaxed as varchar),
                        '},{"tax_group_name":"RTE","tax_group_amount":2.5}]}}') end as tax_totals_json,
               case when id % 3 = 0 then 'false' when id % 3 = 1 then '{"title":"Less Payment"}'
                    else concat('{"content":[{"name":"', name, '","amount":', cast(amount_total as varchar), '}]}') end
                   as invoice_payments_widget
        from account_move""",
}

_NAME = re.compile(r"\b[a-z_]+\b")


def _needed(sql: str, seen: list[str]) -> list[str]:
    """View names the SQL refers to, each after the views it builds on."""
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, recursive: bool = False) -> str:
    """Put the views a query needs in front of it."""
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in _needed(sql, []))
    sql = sql.strip()
    own = sql.lower().startswith("with ")
    return f"with {'recursive ' if recursive else ''}{views}{',' + sql[4:] if own else chr(10) + sql}"
