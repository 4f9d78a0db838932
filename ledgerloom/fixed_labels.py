"""Header labels and column types.

Constants that have to be exactly this for the results to be right; no logic.
Larger registries are a parameter: see ``registry.load_registry``.
"""

# Header label (lower case) -> registry column.
ALIASES = {
    "total assets": "total_assets",
    "total asset": "total_assets",
    "assets": "total_assets",
    "total liabilities": "total_liabilities",
    "liabilities": "total_liabilities",
    "shareholders' equity": "total_shareholders_equity",
    "stockholders' equity": "total_shareholders_equity",
    "shareholders equity": "total_shareholders_equity",
    "stockholders equity": "total_shareholders_equity",
    "total equity": "total_shareholders_equity",
    "equity": "total_shareholders_equity",
    "cash and cash equivalents": "cash_and_equivalents",
    "cash & cash equivalents": "cash_and_equivalents",
    "cash and equivalents": "cash_and_equivalents",
    "cash, cash equivalents and restricted cash": "cash_and_equivalents",
    "marketable securities": "marketable_securities",
    "short-term marketable securities": "marketable_securities",
    "available-for-sale securities": "marketable_securities",
    "accounts receivable": "accounts_receivable",
    "accounts receivable, net": "accounts_receivable",
    "trade receivables": "accounts_receivable",
    "inventories": "inventory",
    "inventory": "inventory",
    "prepaid expenses and other current assets": "prepaid_expenses_and_other_current_assets",
    "prepaid expenses": "prepaid_expenses_and_other_current_assets",
    "other current assets": "prepaid_expenses_and_other_current_assets",
    "property, plant and equipment": "property_plant_equipment",
    "property, plant and equipment, net": "property_plant_equipment",
    "property plant and equipment": "property_plant_equipment",
    "ppe": "property_plant_equipment",
    "operating lease right-of-use assets": "operating_lease_right_of_use_assets",
    "right-of-use assets": "operating_lease_right_of_use_assets",
    "goodwill": "goodwill_and_intangibles",
    "intangible assets": "goodwill_and_intangibles",
    "goodwill and intangible assets": "goodwill_and_intangibles",
    "deferred tax assets": "deferred_tax_assets",
    "other non-current assets": "other_non_current_assets",
    "other assets": "other_non_current_assets",
    "accounts payable": "accounts_payable",
    "trade payables": "accounts_payable",
    "total trade payables": "accounts_payable",
    "accrued expenses": "accrued_expenses_and_other_current_liabilities",
    "accrued liabilities": "accrued_expenses_and_other_current_liabilities",
    "accrued expenses and other current liabilities": "accrued_expenses_and_other_current_liabilities",
    "deferred revenue": "deferred_revenue_current",
    "deferred revenue, current": "deferred_revenue_current",
    "short-term debt": "short_term_debt",
    "short term borrowings": "short_term_debt",
    "short-term borrowings": "short_term_debt",
    "commercial paper": "short_term_debt",
    "operating lease liabilities, current": "operating_lease_liabilities_current",
    "long-term debt": "long_term_debt",
    "long term borrowings": "long_term_debt",
    "long-term borrowings": "long_term_debt",
    "term debt": "long_term_debt",
    "operating lease liabilities, non-current": "operating_lease_liabilities_non_current",
    "operating lease liabilities": "operating_lease_liabilities_non_current",
    "deferred revenue, non-current": "deferred_revenue_non_current",
    "deferred tax liabilities": "deferred_tax_liabilities",
    "other non-current liabilities": "other_non_current_liabilities",
    "other liabilities": "other_non_current_liabilities",
    "common stock": "common_stock",
    "equity share capital": "common_stock",
    "share capital": "common_stock",
    "additional paid-in capital": "additional_paid_in_capital",
    "other equity": "total_shareholders_equity",
    "retained earnings": "retained_earnings",
    "retained earnings / (accumulated deficit)": "retained_earnings",
    "accumulated deficit": "retained_earnings",
    "capital work-in-progress": "property_plant_equipment",
    "capital work in progress": "property_plant_equipment",
    "cwip": "property_plant_equipment",
    "accumulated other comprehensive income": "accumulated_other_comprehensive_income",
    "accumulated other comprehensive loss": "accumulated_other_comprehensive_income",
    "accumulated other comprehensive income (loss)": "accumulated_other_comprehensive_income",
    "treasury stock": "treasury_stock",
    "current assets": "total_current_assets",
    "total current assets": "total_current_assets",
    "current liabilities": "total_current_liabilities",
    "total current liabilities": "total_current_liabilities",
    "revenue": "total_revenue",
    "net sales": "total_revenue",
    "net revenue": "total_revenue",
    "total revenue": "total_revenue",
    "total net sales": "total_revenue",
    "sales": "revenue_from_operations",
    "revenue from operations": "revenue_from_operations",
    "other income": "other_income",
    "cost of goods sold": "cost_of_goods_sold",
    "cost of sales": "cost_of_goods_sold",
    "cost of revenue": "cost_of_goods_sold",
    "cogs": "cost_of_goods_sold",
    "gross profit": "gross_profit",
    "gross margin": "gross_profit",
    "selling and marketing": "selling_and_marketing_expenses",
    "general and administrative": "general_and_administrative_expenses",
    "selling, general and administrative": "sg_and_a_expenses",
    "sg&a": "sg_and_a_expenses",
    "employee benefits expense": "sg_and_a_expenses",
    "employee benefit expenses": "sg_and_a_expenses",
    "research and development": "r_and_d_expenses",
    "r&d": "r_and_d_expenses",
    "restructuring and other charges": "restructuring_and_other_charges",
    "operating expenses": "operating_expenses",
    "total operating expenses": "operating_expenses",
    "operating income": "operating_income",
    "operating profit": "operating_income",
    "ebitda": "ebitda",
    "depreciation and amortization": "depreciation_and_amortization",
    "depreciation & amortization": "depreciation_and_amortization",
    "ebit": "ebit",
    "interest income": "interest_and_dividend_income",
    "interest and dividend income": "interest_and_dividend_income",
    "interest expense": "interest_expense",
    "finance costs": "interest_expense",
    "other income (expense), net": "other_non_operating_income_expense",
    "income before tax": "profit_before_tax",
    "profit before tax": "profit_before_tax",
    "pbt": "profit_before_tax",
    "income before provision for income taxes": "profit_before_tax",
    "earnings before tax": "profit_before_tax",
    "income tax expense": "tax_expense",
    "provision for income taxes": "tax_expense",
    "tax expense": "tax_expense",
    "net income": "net_income",
    "net profit": "net_income",
    "net earnings": "net_income",
    "profit for the year": "net_income",
    "profit after tax": "net_income",
    "pat": "net_income",
    "basic eps": "eps_basic",
    "basic earnings per share": "eps_basic",
    "diluted eps": "eps_diluted",
    "diluted earnings per share": "eps_diluted",
    "weighted-average shares outstanding, basic": "weighted_average_shares_basic",
    "weighted-average shares outstanding, diluted": "weighted_average_shares_diluted",
    "cash from operations": "net_cash_from_operating_activities",
    "net cash provided by operating activities": "net_cash_from_operating_activities",
    "net cash from operating activities": "net_cash_from_operating_activities",
    "operating cash flow": "net_cash_from_operating_activities",
    "share-based compensation expense": "share_based_compensation",
    "stock-based compensation": "share_based_compensation",
    "depreciation and amortization (cash flow)": "depreciation_and_amortization_cf",
    "change in operating assets and liabilities": "change_in_operating_assets_liabilities",
    "cash from investing": "net_cash_from_investing_activities",
    "net cash used in investing activities": "net_cash_from_investing_activities",
    "net cash from investing activities": "net_cash_from_investing_activities",
    "purchases of marketable securities": "purchases_of_investments",
    "purchases of investments": "purchases_of_investments",
    "proceeds from maturities of marketable securities": "sales_maturities_of_investments",
    "sales of investments": "sales_maturities_of_investments",
    "cash from financing": "net_cash_from_financing_activities",
    "net cash used in financing activities": "net_cash_from_financing_activities",
    "net cash from financing activities": "net_cash_from_financing_activities",
    "capital expenditures": "capital_expenditure",
    "capital expenditure": "capital_expenditure",
    "additions to property, plant and equipment": "capital_expenditure",
    "capex": "capital_expenditure",
    "dividends paid": "dividends_paid",
    "payments of dividends": "dividends_paid",
    "repurchases of common stock": "repurchase_of_common_stock",
    "repurchase of common stock": "repurchase_of_common_stock",
    "effect of exchange rate changes on cash": "effect_of_exchange_rate_on_cash",
    "net change in cash": "net_change_in_cash",
    "increase (decrease) in cash": "net_change_in_cash",
    "cash and cash equivalents, beginning of period": "cash_beginning_of_period",
    "cash and cash equivalents, end of period": "cash_end_of_period",
    "opening balance": "opening_balance",
    "beginning balance": "opening_balance",
    "closing balance": "closing_balance",
    "ending balance": "closing_balance",
    "total deposits": "total_deposits",
    "total credits": "total_deposits",
    "total withdrawals": "total_withdrawals",
    "total debits": "total_withdrawals",
    "invoice total": "total_amount",
    "amount due": "amount_due",
    "subtotal": "subtotal_amount",
    "tax": "tax_amount",
    "shipping": "shipping_amount",
    "discount": "discount_amount",
    "subsidiary": "entity_name",
    "subsidiary name": "entity_name",
    "name of subsidiary": "entity_name",
    "name of registrant": "parent_entity_name",
    "parent company": "parent_entity_name",
    "holding company": "parent_entity_name",
    "jurisdiction": "jurisdiction",
    "jurisdiction of incorporation": "jurisdiction",
    "state or country of incorporation": "jurisdiction",
    "place of incorporation": "jurisdiction",
    "ownership": "ownership_percentage",
    "percentage of ownership": "ownership_percentage",
    "% of ownership": "ownership_percentage",
    "percentage of voting power": "ownership_percentage",
}

# Schema -> column -> type name, for the schemas the built-in rules check.
CORE_SCHEMAS = {
    "vendor_invoice_headers": {
        "invoice_id": "str",
        "invoice_number": "str",
        "vendor_name": "str",
        "vendor_address": "str",
        "vendor_tax_id": "str",
        "vendor_email": "str",
        "vendor_phone": "str",
        "buyer_name": "str",
        "buyer_address": "str",
        "buyer_tax_id": "str",
        "invoice_date": "datetime",
        "due_date": "datetime",
        "delivery_date": "datetime",
        "subtotal_amount": "float",
        "tax_amount": "float",
        "discount_amount": "float",
        "shipping_amount": "float",
        "total_amount": "float",
        "amount_due": "float",
        "amount_paid": "float",
        "currency": "str",
        "payment_terms": "str",
        "purchase_order_number": "str",
        "remittance_address": "str",
        "additional_metadata": "dict",
    },
    "invoice_line_items": {
        "item_code": "str",
        "description": "str",
        "quantity": "float",
        "unit_of_measure": "str",
        "unit_price": "float",
        "tax_rate": "float",
        "tax_amount": "float",
        "discount_amount": "float",
        "total_amount": "float",
        "additional_metadata": "dict",
    },
    "bank_statement_headers": {
        "account_number": "str",
        "routing_number": "str",
        "iban": "str",
        "swift_bic": "str",
        "bank_name": "str",
        "bank_address": "str",
        "statement_period_start": "datetime",
        "statement_period_end": "datetime",
        "statement_date": "datetime",
        "opening_balance": "float",
        "closing_balance": "float",
        "total_deposits": "float",
        "total_withdrawals": "float",
        "total_fees": "float",
        "total_interest": "float",
        "account_holder_name": "str",
        "account_holder_address": "str",
        "currency": "str",
        "additional_metadata": "dict",
    },
    "bank_statement_transactions": {
        "transaction_date": "datetime",
        "post_date": "datetime",
        "description": "str",
        "check_number": "str",
        "transaction_type": "str",
        "withdrawal_amount": "float",
        "deposit_amount": "float",
        "balance": "float",
        "additional_metadata": "dict",
    },
    "standardized_income_statement": {
        "revenue_from_operations": "float",
        "other_income": "float",
        "total_revenue": "float",
        "cost_of_goods_sold": "float",
        "gross_profit": "float",
        "selling_and_marketing_expenses": "float",
        "general_and_administrative_expenses": "float",
        "sg_and_a_expenses": "float",
        "r_and_d_expenses": "float",
        "restructuring_and_other_charges": "float",
        "operating_expenses": "float",
        "operating_income": "float",
        "ebitda": "float",
        "depreciation_and_amortization": "float",
        "ebit": "float",
        "interest_and_dividend_income": "float",
        "interest_expense": "float",
        "other_non_operating_income_expense": "float",
        "profit_before_tax": "float",
        "tax_expense": "float",
        "net_income": "float",
        "eps_basic": "float",
        "eps_diluted": "float",
        "weighted_average_shares_basic": "float",
        "weighted_average_shares_diluted": "float",
        "period": "str",
        "additional_metadata": "dict",
    },
    "standardized_balance_sheet": {
        "cash_and_equivalents": "float",
        "marketable_securities": "float",
        "accounts_receivable": "float",
        "inventory": "float",
        "prepaid_expenses_and_other_current_assets": "float",
        "total_current_assets": "float",
        "property_plant_equipment": "float",
        "operating_lease_right_of_use_assets": "float",
        "goodwill_and_intangibles": "float",
        "deferred_tax_assets": "float",
        "other_non_current_assets": "float",
        "total_assets": "float",
        "accounts_payable": "float",
        "accrued_expenses_and_other_current_liabilities": "float",
        "deferred_revenue_current": "float",
        "short_term_debt": "float",
        "operating_lease_liabilities_current": "float",
        "total_current_liabilities": "float",
        "long_term_debt": "float",
        "operating_lease_liabilities_non_current": "float",
        "deferred_revenue_non_current": "float",
        "deferred_tax_liabilities": "float",
        "other_non_current_liabilities": "float",
        "total_liabilities": "float",
        "common_stock": "float",
        "additional_paid_in_capital": "float",
        "retained_earnings": "float",
        "accumulated_other_comprehensive_income": "float",
        "treasury_stock": "float",
        "total_shareholders_equity": "float",
        "period": "str",
        "additional_metadata": "dict",
    },
    "standardized_cash_flow": {
        "net_cash_from_operating_activities": "float",
        "share_based_compensation": "float",
        "depreciation_and_amortization_cf": "float",
        "change_in_operating_assets_liabilities": "float",
        "capital_expenditure": "float",
        "purchases_of_investments": "float",
        "sales_maturities_of_investments": "float",
        "net_cash_from_investing_activities": "float",
        "dividends_paid": "float",
        "debt_issued_or_repaid": "float",
        "repurchase_of_common_stock": "float",
        "net_cash_from_financing_activities": "float",
        "effect_of_exchange_rate_on_cash": "float",
        "net_change_in_cash": "float",
        "cash_beginning_of_period": "float",
        "cash_end_of_period": "float",
        "period": "str",
        "additional_metadata": "dict",
    },
    "sec_10k_footnote_schedule": {
        "schedule_title": "str",
        "segment_or_category_name": "str",
        "metric_name": "str",
        "amount": "float",
        "currency": "str",
        "period": "str",
        "additional_metadata": "dict",
    },
    "corporate_subsidiaries": {
        "entity_name": "str",
        "parent_entity_name": "str",
        "jurisdiction": "str",
        "ownership_percentage": "float",
        "relationship_type": "str",
        "additional_metadata": "dict",
    },
}
