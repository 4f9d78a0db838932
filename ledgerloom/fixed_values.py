"""Fixed values.

Everything in this module is a constant that has to be exactly this for the
results to be right: words, rates, patterns, limits and label tables.  There
is no logic here.
"""

# --- numbers ---------------------------------------------------------------

# Suffix of a number cell -> multiplier.
NUMBER_SUFFIX = {
    "k": 1e3,
    "thousand": 1e3,
    "lakh": 1e5,
    "lakhs": 1e5,
    "lac": 1e5,
    "lacs": 1e5,
    "m": 1e6,
    "mm": 1e6,
    "million": 1e6,
    "millions": 1e6,
    "crore": 1e7,
    "crores": 1e7,
    "cr": 1e7,
    "cr.": 1e7,
    "b": 1e9,
    "bn": 1e9,
    "billion": 1e9,
}
NUMBER_SUFFIX_PATTERN = (
    r"(?i)(bn|mm|billion|millions|million|crores?|cr\.?|lakhs?|lacs?|thousand|k|b|m)$"
)

# Words of a scale footnote, in the order they are tried.
SCALE_WORDS = [
    (r"\b(?:k|thousands?)\b", 1e3),
    (r"\b(?:lakhs?|lacs?)\b", 1e5),
    (r"\b(?:m|mm|millions?)\b", 1e6),
    (r"\b(?:crores?|cr)\b", 1e7),
    (r"\b(?:b|bn|billions?)\b", 1e9),
]

# Fields that a scale footnote never multiplies.
UNSCALED_FIELDS = [
    "eps_basic",
    "eps_diluted",
    "weighted_average_shares_basic",
    "weighted_average_shares_diluted",
    "tax_rate",
    "unit_price",
    "quantity",
    "duty_rate",
]

ABS_TOLERANCE = 0.02
REL_TOLERANCE = 0.002

# Units per US dollar.
UNITS_PER_USD = {
    "USD": 1.0,
    "INR": 83.50,
    "EUR": 0.92,
    "GBP": 0.78,
    "JPY": 155.0,
    "CAD": 1.36,
    "AUD": 1.50,
}

# --- schema system ---------------------------------------------------------

CONTEXT_COLUMNS = [
    "context_entity_name",
    "context_reporting_period",
    "context_currency",
    "context_scale",
]

# Bookkeeping keys of the drift bag; never drift themselves.
META_KEYS = [
    "row_status",
    "critic_error",
    "reflexion_meta",
    "critic_results",
    "critic_version",
    "hard_failures",
    "soft_failures",
    "confidence_score",
    "promotion_band",
    "confidence_reasons",
]

# Keys that a correction diff skips.
PATCH_SKIP_KEYS = [
    "additional_metadata",
    "critic_error",
    "row_status",
    "reflexion_meta",
    "_context_scale_multiplier",
    "_raw_additional_metadata",
]

# Column -> other keys under which a view looks for its value.
VIEW_SYNONYMS = {
    "net_income": ["net_income", "net_income_loss", "consolidated_net_income", "net_earnings", "Net Income"],
    "total_revenue": ["total_revenue", "total_net_sales", "revenue", "net_sales", "Total Net Sales", "Total Revenue"],
    "revenue_from_operations": ["revenue_from_operations", "operating_revenue", "total_revenue", "net_sales"],
    "cost_of_goods_sold": ["cost_of_goods_sold", "cost_of_sales", "cogs", "Cost of Sales"],
    "gross_profit": ["gross_profit", "gross_margin", "Gross Profit"],
    "operating_income": ["operating_income", "operating_profit", "income_from_operations", "Operating Income"],
    "tax_expense": ["tax_expense", "provision_for_income_taxes", "income_tax_expense", "Income Taxes"],
    "eps_basic": ["eps_basic", "basic_eps", "basic_earnings_per_share"],
    "eps_diluted": ["eps_diluted", "diluted_eps", "diluted_earnings_per_share"],
    "net_cash_from_operating_activities": ["net_cash_from_operating_activities", "operating_cash_flow", "cash_from_operations", "Net Cash from Operating Activities"],
    "share_based_compensation": ["share_based_compensation", "stock_based_compensation"],
    "depreciation_and_amortization_cf": ["depreciation_and_amortization_cf", "depreciation_and_amortization"],
    "change_in_operating_assets_liabilities": ["change_in_operating_assets_liabilities", "working_capital_changes"],
    "capital_expenditure": ["capital_expenditure", "capex", "capital_expenditures"],
    "net_cash_from_investing_activities": ["net_cash_from_investing_activities", "investing_cash_flow", "Net Cash from Investing Activities"],
    "net_cash_from_financing_activities": ["net_cash_from_financing_activities", "financing_cash_flow", "Net Cash from Financing Activities"],
}

# Metric -> names tried, in order, when a result row lacks the metric.
METRIC_SYNONYMS = {
    "net_income": ["net_income", "net_income_loss", "consolidated_net_income", "net_earnings", "net_profit", "net_loss", "net income", "consolidated net income"],
    "total_revenue": ["total_revenue", "total_net_sales", "revenue", "net_sales", "total_sales", "revenues", "total net sales", "total revenue", "net sales"],
    "revenue_from_operations": ["revenue_from_operations", "operating_revenue", "total_revenue", "net_sales", "revenue"],
    "cost_of_goods_sold": ["cost_of_goods_sold", "cost_of_sales", "cogs", "cost_of_products_sold", "cost of sales", "cost of goods sold"],
    "gross_profit": ["gross_profit", "gross_margin", "gross profit", "gross margin"],
    "operating_income": ["operating_income", "operating_profit", "income_from_operations", "operating income", "income from operations"],
    "tax_expense": ["tax_expense", "provision_for_income_taxes", "income_tax_expense", "income_taxes", "provision for income taxes", "tax expense"],
    "eps_basic": ["eps_basic", "basic_eps", "basic_earnings_per_share", "basic earnings per share", "basic"],
    "eps_diluted": ["eps_diluted", "diluted_eps", "diluted_earnings_per_share", "diluted earnings per share", "diluted"],
    "net_cash_from_operating_activities": ["net_cash_from_operating_activities", "operating_cash_flow", "cash_from_operations", "net_cash_provided_by_operating_activities", "cash_provided_by_operating_activities", "operating_activities", "cash generated by operating activities", "net cash provided by operating activities"],
    "share_based_compensation": ["share_based_compensation", "stock_based_compensation", "share_based_compensation_expense", "stock-based compensation"],
    "depreciation_and_amortization_cf": ["depreciation_and_amortization_cf", "depreciation_and_amortization", "depreciation_and_amortization_expense", "depreciation and amortization"],
    "change_in_operating_assets_liabilities": ["change_in_operating_assets_liabilities", "changes_in_operating_assets_and_liabilities", "working_capital_changes", "changes in operating assets and liabilities"],
    "capital_expenditure": ["capital_expenditure", "capex", "capital_expenditures", "payments_for_acquisition_of_property_plant_and_equipment", "additions_to_property_plant_and_equipment", "capital expenditures"],
    "net_cash_from_investing_activities": ["net_cash_from_investing_activities", "investing_cash_flow", "net_cash_used_in_investing_activities", "cash_used_in_investing_activities", "investing_activities", "net cash used in investing activities"],
    "net_cash_from_financing_activities": ["net_cash_from_financing_activities", "financing_cash_flow", "net_cash_used_in_financing_activities", "cash_used_in_financing_activities", "financing_activities", "net cash used in financing activities"],
    "net_change_in_cash": ["net_change_in_cash", "net_increase_decrease_in_cash", "change_in_cash", "net increase in cash and cash equivalents"],
}

# Words that make a key of raw JSON text a finance number.
BLOB_NUMBER_WORDS = [
    "asset", "revenue", "income", "liability", "equity", "cash", "debt", "profit",
    "amount", "total", "subtotal", "tax", "eps", "cost", "expense", "margin",
    "payable", "receivable",
]

# Order in which other tables of a document stand in for an empty view.
FALLBACK_TABLE_ORDER = [
    "standardized_balance_sheet",
    "standardized_income_statement",
    "standardized_cash_flow",
    "vendor_invoice_headers",
]


# --- confidence ------------------------------------------------------------

AUTO_PROMOTE_MIN = 0.85
REVIEW_MIN = 0.55

# --- table structure and layout --------------------------------------------

ROWS_PER_BATCH = 10
BATCH_LOOK_BACK = 3
PAGES_PER_CHUNK = 5
TABLE_SPAN_BOTTOM = 0.85
TABLE_SPAN_TOP = 0.15
PAGE_HEADER_Y = 50.0
PAGE_FOOTER_Y = 742.0
LINE_EPSILON = 15.0
WEAK_TEXT_LENGTH = 160

# --- text ------------------------------------------------------------------

CHUNK_CHARS = 1500
CHUNK_OVERLAP = 200
CHUNK_BREAKS = ["\n\n", "\n", ". ", " "]

# Schema -> (weight, patterns); a hit on each pattern counts once.
ROUTER_RULES = [
    ("standardized_balance_sheet", 1.0, [
        r"balance\s*sheets?",
        r"statement\s+of\s+financial\s+position",
        r"consolidated\s+balance\s+sheets?",
        r"total\s+assets",
        r"shareholders['’]?\s+equity",
        r"stockholders['’]?\s+equity",
        r"liabilities\s+and\s+equity",
        r"current\s+assets",
        r"current\s+liabilities",
    ]),
    ("standardized_income_statement", 1.0, [
        r"income\s+statements?",
        r"profit\s+and\s+loss",
        r"\bp\s*&\s*l\b",
        r"statement\s+of\s+operations",
        r"consolidated\s+statements?\s+of\s+(operations|income|earnings|comprehensive\s+income)",
        r"net\s+income",
        r"net\s+sales",
        r"revenue\s+from\s+operations",
        r"total\s+revenues?",
        r"cost of (goods|sales|revenue)",
        r"\bebitda\b",
    ]),
    ("standardized_cash_flow", 1.0, [
        r"cash\s+flows?",
        r"consolidated\s+statements?\s+of\s+cash\s+flows?",
        r"operating activities",
        r"investing activities",
        r"financing activities",
        r"net change in cash",
    ]),
    ("corporate_subsidiaries", 0.95, [
        r"subsidiaries\s+of\s+the\s+registrant",
        r"exhibit\s+21",
        r"jurisdiction\s+of\s+incorporation",
        r"percentage\s+of\s+ownership",
        r"name\s+of\s+subsidiary",
        r"subsidiary\s+company",
        r"holding\s+company",
        r"basis\s+of\s+consolidation",
    ]),
    ("sec_10k_footnote_schedule", 0.85, [
        r"note\s+\d+",
        r"segment\s+reporting",
        r"disaggregated\s+revenue",
        r"lease\s+commitments?",
        r"debt\s+maturities",
    ]),
    ("bank_statement_transactions", 0.95, [
        r"bank\s+statement",
        r"opening balance",
        r"closing balance",
        r"withdrawal",
        r"deposit",
        r"running balance",
    ]),
    ("bank_statement_headers", 0.9, [
        r"account number",
        r"statement period",
        r"beginning balance",
        r"ending balance",
    ]),
    ("vendor_invoice_headers", 0.95, [
        r"\binvoice\b",
        r"bill to",
        r"invoice number",
        r"amount due",
        r"subtotal",
    ]),
    ("invoice_line_items", 0.85, [
        r"unit price",
        r"quantity",
        r"line total",
        r"description of (goods|services)",
    ]),
    ("purchase_order_headers", 0.9, [
        r"purchase\s+order",
        r"\bpo\s*#",
        r"\bpo number",
    ]),
    ("receipt_headers", 0.85, [
        r"\breceipt\b",
        r"merchant",
        r"thank you for your (purchase|business)",
    ]),
    ("tax_form_headers", 0.9, [
        r"\bw-?2\b",
        r"form 1040",
        r"adjusted gross income",
        r"medicare wages",
    ]),
    ("utility_bills", 0.85, [
        r"utility",
        r"kwh",
        r"meter reading",
        r"amount due",
    ]),
]
ROUTER_MIN_SCORE = 1.5
ROUTER_MIN_MARGIN = 0.75

INDIAN_PATTERNS = [
    r"companies\s+act",
    r"ind\s+as",
    r"schedule\s+iii",
    r"sebi",
    r"bse\s+limited",
    r"national\s+stock\s+exchange",
    r"\bcin\b",
    r"crores?",
    r"lakhs?",
    r"₹",
    r"rs\.",
    r"standalone\s+financial",
]
US_PATTERNS = [
    r"form\s+10-?k",
    r"securities\s+and\s+exchange\s+commission",
    r"commission\s+file\s+number",
    r"us-gaap",
    r"item\s+8\.",
]

IDENTIFIER_PATTERNS = {
    "cin": r"(?i)\b([LU]\d{5}[A-Z]{2}\d{4}PLC\d{6})\b",
    "cik": r"(?i)\bCIK[:\s]*(\d{6,10})\b",
    "ticker": r"\bTicker[:\s]*([A-Z]{1,5})\b",
    "nse_symbol": r"(?i)\bNSE[:\s]*([A-Z0-9_-]{2,15})\b",
}

# Scale footnotes, in the order they are tried.
SCALE_FOOTNOTES = [
    r"in\s+millions?",
    r"usd\s+thousands?",
    r"in\s+thousands?",
    r"\$\s*in\s*millions?",
    r"\$\s*in\s*thousands?",
]

FINANCIAL_HINTS = [
    "balance sheet", "income statement", "profit and loss", "p&l", "cash flow",
    "statement of financial", "bank statement", "invoice", "accounts payable",
    "accounts receivable", "ebitda", "shareholders", "retained earnings",
]

GRAPH_SIGNAL_PATTERNS = [
    r"related\s+party",
    r"subsidiary",
    r"holding\s+company",
    r"joint\s+venture",
    r"director",
    r"key\s+managerial",
    r"kmp",
    r"auditor",
    r"guarantee",
    r"facility\s+agreement",
    r"borrowing",
    r"acquisition",
    r"merger",
    r"amalgamation",
    r"jurisdiction",
    r"ownership",
    r"exhibit\s+21",
    r"consolidation",
]
GRAPH_INGEST_EXTRA_PATTERNS = [r"pledged?", r"contingent\s+liabilit"]

AGGREGATION_PATTERNS = [
    r"\btotal\b", r"\bsum\b", r"\baverage\b", r"\bavg\b", r"\bcount\b",
    r"\bhow many\b", r"\baggregate\b", r"\bacross all\b", r"\boverall\b",
    r"\brollup\b", r"\bmean\b", r"\bmedian\b",
]

# --- failures --------------------------------------------------------------

PERMANENT_PATTERNS = [
    r"no critic registered",
    r"critic\.missing_",
    r"empty extracted",
    r"unsupported schema",
    r"unknown_table",
    r"could not classify",
    r"no table detected",
    r"file not found",
    r"ocr returned empty",
    r"missing page",
]
RETRYABLE_PATTERNS = [
    r"logic error",
    r"\[bs\.",
    r"\[is\.",
    r"\[cf\.",
    r"\[bank\.",
    r"\[inv\.",
    r"\[po\.",
    r"\[receipt\.",
    r"\[grounding\.",
    r"completeness",
    r"total_assets",
    r"gross_profit",
    r"net_change_in_cash",
    r"closing",
    r"running balance",
    r"line total",
    r"amount_due",
    r"does not match",
    r"exceeds",
    r"incomplete extraction",
    r"Δ=",
    r"hint:",
]
DEAD_LETTER_PERMANENT_HINTS = [
    "permanent",
    "no critic registered",
    "unknown_table",
    "could not classify",
    "empty extracted",
    "file not found",
    "ocr returned empty",
    "missing page",
    "unsupported schema",
]
MAX_RETRIES = 3
RETRY_TTL_SECONDS = 3600
REVIEW_TIMEOUT_SECONDS = 48 * 3600
ASSEMBLY_TIMEOUT_SECONDS = 900
ETAG_CLAIM_SECONDS = 300
DISCOVERY_BATCH = 500
ETAG_MEMORY_SECONDS = 24 * 3600

# --- graph and vectors -----------------------------------------------------

STOP_ENTITIES = [
    "COMPANY", "THE COMPANY", "THE GROUP", "DIRECTORS", "NOTE", "NOTES",
    "MANAGEMENT", "BOARD", "THIS SECTION", "UNAUDITED", "AUDITED", "PAGE",
    "YEAR", "TOTAL", "AMOUNT", "FINANCIAL STATEMENTS", "STATEMENT", "CURRENCY",
    "NET REVENUE", "BALANCE SHEET", "INCOME STATEMENT", "ASSETS", "LIABILITIES",
]

# Template -> (edge types or None for any, side whose name is searched, undirected)
GRAPH_TEMPLATES = {
    "subsidiaries": (["OWNS", "HAS_SUBSIDIARY"], "subject", False),
    "parent_company": (["OWNS", "HAS_SUBSIDIARY"], "object", False),
    "key_personnel": (["DIRECTOR_OF", "CEO_OF", "CFO_OF", "WORKS_FOR", "KEY_MANAGERIAL_PERSONNEL"], "object", False),
    "auditors": (["AUDITS", "STATUTORY_AUDITOR"], "object", False),
    "relationships": (None, "subject", True),
}

RERANK_TERMS = [
    "operating income", "interest expense", "term loan", "ebit",
    "cash and cash equivalents", "short-term debt", "repayable", "repay",
]
VECTOR_CANDIDATES = 50
VECTOR_RETURNED = 5
DEFAULT_VECTOR_DIM = 384
DEFAULT_VECTOR_VALUE = 1e-5

# Namespace of name-based ids (the OID namespace of RFC 4122).
UUID_OID_NAMESPACE_HEX = "6ba7b8129dad11d180b400c04fd430c8"

# --- rules -----------------------------------------------------------------

# Schemas that may never pass without at least one rule.
FINANCIAL_SCHEMAS = [
    "standardized_balance_sheet",
    "standardized_income_statement",
    "standardized_cash_flow",
    "bank_statement_headers",
    "bank_statement_transactions",
    "vendor_invoice_headers",
    "invoice_line_items",
    "purchase_order_headers",
    "purchase_order_line_items",
    "receipt_headers",
    "receipt_line_items",
    "tax_form_headers",
    "utility_bills",
]

# Fields whose value must be found in the source text.
GROUNDING_FIELDS = {
    "standardized_balance_sheet": ["total_assets", "total_liabilities", "total_shareholders_equity", "cash_and_equivalents", "total_current_assets", "total_current_liabilities"],
    "standardized_income_statement": ["total_revenue", "gross_profit", "operating_income", "net_income"],
    "standardized_cash_flow": ["net_cash_from_operating_activities", "net_cash_from_investing_activities", "net_cash_from_financing_activities", "net_change_in_cash"],
    "sec_10k_footnote_schedule": ["amount"],
    "vendor_invoice_headers": ["total_amount", "subtotal_amount", "tax_amount"],
    "bank_statement_headers": ["opening_balance", "closing_balance"],
}
