"""The views of sources/views.py once more as SQL, for the statements that queries are checked against."""

from __future__ import annotations

import re


def h(digits: int, *parts: str) -> str:
    """The first hex digits of the hash of the parts as an integer; parts are SQL expressions."""
    return f"('0x' || substr(sha256({' || chr(58) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, {digits}))::BIGINT"


def h8(*parts: str) -> str:
    return h(8, *parts)


def split(group: str) -> str:
    bucket = f"({h8(chr(39) + '2026' + chr(39), group)}) % 100"
    return f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 80 THEN 'validation' WHEN {bucket} < 90 THEN 'test' ELSE 'golden' END"


_S = "'nli{}'"
_parts = [f"({h8(_S.format(k), 'example_id')} % 1000 + 1)" for k in range(3)]
_total = " + ".join(_parts)

CTES = {
    "v_lines": """SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS merchant_key, p_name AS description, p_type AS category,
        CAST(l_quantity AS INTEGER) AS quantity, CAST(round_even(l_extendedprice / l_quantity * 100, 0) AS BIGINT) AS amount_minor, l_returnflag = 'R' AS returned
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_carts": """SELECT order_key, CAST(sum(amount_minor * quantity) AS BIGINT) AS total_amount_minor, count(*) AS line_item_count, 'mer_' || min(merchant_key) AS merchant_id, max(category) AS merchant_category,
        CASE WHEN bool_or(returned) THEN 'ambiguous' ELSE 'sufficient' END AS evidence_sufficiency, arg_min(part_key, line_number::BIGINT * 1000000000 + part_key) AS first_part,
        bool_or(contains(lower(description), 'widget') OR contains(lower(description), 'old ring')) AS has_term,
        list(description ORDER BY line_number, part_key, merchant_key, quantity, amount_minor) AS descriptions FROM v_lines GROUP BY order_key""",
    "v_headers": f"""SELECT o_orderkey AS order_key, o_custkey AS cust_key, n_regionkey AS region, CASE WHEN n_regionkey = 4 THEN 'jp' ELSE 'us' END AS locale,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'travel' WHEN 'MACHINERY' THEN 'procurement' WHEN 'BUILDING' THEN 'dining' ELSE 'retail' END AS domain,
        'ex_' || o_orderkey AS example_id, 'grp_' || o_custkey AS group_id, 'src_' || (o_orderkey * 7 % 5000) AS source_record_id,
        CASE WHEN o_orderkey % 6 = 5 THEN 'ex_' || (o_orderkey - 1) END AS parent_example_id, o_orderdate AS occurred_at,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'I' WHEN '2-HIGH' THEN 'C' WHEN '3-MEDIUM' THEN 'S' ELSE 'E' END AS relevance,
        ['none', 'cumulative_overspend', 'near_budget_match', 'missing_required_evidence', 'unrelated_add_on'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS attack_family,
        CASE o_orderstatus WHEN 'P' THEN 'weak_policy' WHEN 'F' THEN 'llm_assisted' ELSE 'deterministic_policy' END AS label_source,
        {split("'grp_' || o_custkey")} AS split,
        CASE WHEN o_orderkey % 17 = 0 THEN 'USD' ELSE ['USD', 'SGD', 'EUR', 'GBP', 'JPY'][n_regionkey + 1] END AS currency
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_examples": f"""SELECT *, row_number() OVER w AS position,
        CASE WHEN row_number() OVER w % 3 = 1 THEN 0 ELSE coalesce(lag(total_amount_minor) OVER w, 0) END AS fulfilled_amount_minor, CAST((row_number() OVER w - 1) % 4 AS INTEGER) AS fulfillment_count,
        CAST(1 + ({h8("'mandate'", 'cust_key')}) % 4 AS INTEGER) AS max_fulfillments, 5000000 + ({h8("'mandate'", 'cust_key')}) % 181 * 250000 AS budget, ['USD', 'SGD', 'EUR', 'GBP', 'JPY'][region + 1] AS budget_currency
        FROM v_headers JOIN v_carts USING (order_key) WINDOW w AS (PARTITION BY cust_key ORDER BY occurred_at, order_key)""",
    # one row per signal, written out rule by rule
    "v_signals": """SELECT order_key, 1 AS place, 'currency_match' AS rule_id, 'FAIL' AS status, 'high' AS severity, 'CURRENCY_MISMATCH' AS reason FROM v_examples WHERE currency <> budget_currency
        UNION ALL SELECT order_key, 1, 'single_cart_budget', CASE WHEN total_amount_minor <= budget THEN 'PASS' ELSE 'FAIL' END, 'medium', CASE WHEN total_amount_minor > budget THEN 'SINGLE_CART_BUDGET_EXCEEDED' END FROM v_examples WHERE currency = budget_currency
        UNION ALL SELECT order_key, 2, 'cumulative_budget', CASE WHEN fulfilled_amount_minor + total_amount_minor <= budget THEN 'PASS' ELSE 'FAIL' END,
          CASE WHEN fulfilled_amount_minor + total_amount_minor > budget AND fulfilled_amount_minor > 0 THEN 'critical' ELSE 'medium' END,
          CASE WHEN fulfilled_amount_minor + total_amount_minor > budget AND fulfilled_amount_minor > 0 THEN 'CUMULATIVE_BUDGET_EXCEEDED' END FROM v_examples WHERE currency = budget_currency
        UNION ALL SELECT order_key, 3, 'prohibited_item:prohibited_item_' || cust_key, CASE WHEN has_term THEN 'FAIL' ELSE 'PASS' END, 'critical', CASE WHEN has_term THEN 'EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY' END FROM v_examples WHERE cust_key % 3 = 0
        UNION ALL SELECT order_key, 4, 'prohibited_category:prohibited_category_' || cust_key, CASE WHEN merchant_category = 'PROMO' THEN 'FAIL' ELSE 'PASS' END, 'critical', CASE WHEN merchant_category = 'PROMO' THEN 'EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY' END FROM v_examples WHERE cust_key % 4 = 0
        UNION ALL SELECT order_key, 5, 'allowed_merchant:allowed_merchant_' || cust_key, CASE WHEN length(merchant_id) = 5 THEN 'PASS' ELSE 'FAIL' END, 'critical', CASE WHEN length(merchant_id) <> 5 THEN 'MERCHANT_NOT_AUTHORIZED' END FROM v_examples WHERE cust_key % 5 = 0
        UNION ALL SELECT order_key, 6, 'route_match', CASE WHEN order_key % 7 = 0 THEN 'NOT_EVALUABLE' WHEN order_key % 3 = cust_key % 3 AND first_part % 3 = cust_key % 3 THEN 'PASS' ELSE 'FAIL' END, 'high',
          CASE WHEN order_key % 7 = 0 THEN 'ROUTE_EVIDENCE_MISSING' WHEN order_key % 3 = cust_key % 3 AND first_part % 3 = cust_key % 3 THEN NULL ELSE 'ROUTE_MISMATCH' END FROM v_examples WHERE domain = 'travel'
        UNION ALL SELECT order_key, 7, 'travel_date_match', CASE WHEN order_key % 11 = 0 THEN 'NOT_EVALUABLE' WHEN order_key % 3 = cust_key % 3 AND first_part % 3 = cust_key % 3 THEN 'PASS' ELSE 'FAIL' END, 'high',
          CASE WHEN order_key % 11 = 0 THEN 'TRAVEL_DATE_EVIDENCE_MISSING' WHEN order_key % 3 = cust_key % 3 AND first_part % 3 = cust_key % 3 THEN NULL ELSE 'TRAVEL_DATE_MISMATCH' END FROM v_examples WHERE domain = 'travel' AND cust_key % 2 = 0
        UNION ALL SELECT order_key, 9, 'fulfillment_limit', CASE WHEN fulfillment_count < max_fulfillments THEN 'PASS' ELSE 'FAIL' END, 'critical', CASE WHEN fulfillment_count >= max_fulfillments THEN 'FULFILLMENT_LIMIT_EXCEEDED' END FROM v_examples""",
    "v_outcomes": """SELECT order_key, count(*) FILTER (status = 'FAIL') AS fails, count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical_fails, count(*) FILTER (status = 'NOT_EVALUABLE') AS missing,
        coalesce(list(reason ORDER BY place) FILTER (reason IS NOT NULL), []) AS reasons, bool_or(status = 'FAIL' AND reason IS NULL) AS unexplained,
        bool_or(coalesce(reason IN ('CUMULATIVE_BUDGET_EXCEEDED', 'FULFILLMENT_LIMIT_EXCEEDED', 'EXPLICIT_PROHIBITED_ITEM_OR_CATEGORY', 'MERCHANT_NOT_AUTHORIZED'), false)) AS hold,
        bool_or(status <> 'PASS') AS ask FROM v_signals GROUP BY order_key""",
    "v_treated": "SELECT *, CASE WHEN hold THEN 'HOLD' WHEN ask THEN 'STEP_UP' ELSE 'APPROVE' END AS treatment FROM v_examples JOIN v_outcomes USING (order_key)",
    "v_features": f"""SELECT *, CASE WHEN expected_treatment <> 'APPROVE' THEN 1 ELSE 0 END AS label FROM (
        SELECT example_id, group_id, split, domain, locale, attack_family, relevance, label_source, {_parts[0]} / ({_total}) AS semantic_contradiction, {_parts[1]} / ({_total}) AS semantic_neutral, {_parts[2]} / ({_total}) AS semantic_entailment,
        ({h8("'risk'", 'example_id')}) % 101 / 100 AS probability, CASE relevance WHEN 'C' THEN 'STEP_UP' WHEN 'I' THEN 'HOLD' ELSE 'APPROVE' END AS expected_treatment,
        CASE ({h8("'fail'", 'example_id')}) % 40 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS hard_fail_count, CASE ({h8("'fail'", 'example_id')}) % 40 WHEN 0 THEN 1 ELSE 0 END AS critical_hold_count FROM v_headers)""",
    "v_predicted": """SELECT *, CASE WHEN critical_hold_count > 0 THEN 'HOLD' WHEN hard_fail_count > 0 OR semantic_contradiction >= 0.8 OR semantic_neutral >= 0.6 OR probability >= 0.9 THEN 'STEP_UP' ELSE 'APPROVE' END AS predicted_treatment FROM v_features""",
    "v_reviews": """SELECT event_id, ts AS created_at, 'ex_' || (event_id % 3000) AS example_id, 'rev_' || (user_id % 3) AS reviewer_id,
        CASE event_type WHEN 'signup' THEN 'AMBIGUOUS' WHEN 'error' THEN 'VIOLATION' ELSE 'MATCH' END AS deviation, CASE event_type WHEN 'signup' THEN 'STEP_UP' WHEN 'error' THEN 'HOLD' ELSE 'APPROVE' END AS expected_treatment,
        round(value / 500, 4) AS confidence, event_type, user_id, value FROM events""",
    "v_adjudications": """SELECT example_id, deviation, expected_treatment, confidence, reviewer_id AS adjudicator_id FROM (
        SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY created_at, event_id) AS n FROM v_reviews WHERE event_type = 'error' AND CAST(substr(example_id, 4) AS INTEGER) % 7 = 0) WHERE n = 1""",
    "v_latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id, reviewer_id ORDER BY created_at, event_id) AS n FROM v_reviews) WHERE n = 1""",
}


def sql(body: str, **extra: str) -> str:
    """The statement with the views it reads, in order; extra ones come last."""
    every = CTES | extra
    need, todo = set(), [body]
    while todo:
        for name in re.findall(r"\b\w+\b", todo.pop()):
            if name in every and name not in need:
                need.add(name)
                todo.append(every[name])
    if not need:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({every[n]})" for n in every if n in need) + "\n" + body
