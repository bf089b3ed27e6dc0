"""Column names shared by every operator, and the fixed vocabularies."""

# The canonical order-line frame and its optional passthrough columns.
CANONICAL = [
    "customer_id", "order_id", "order_date", "quantity",
    "unit_price", "line_value", "product", "country",
]
CONTACT = ["customer_email", "customer_name"]
PASSTHROUGH = CONTACT + [
    "category", "product_name", "product_desc", "description",
    "cat_1_ID", "cat_1_name", "cat_2_ID", "cat_2_name",
]
CATALOG_COLUMNS = ["product_name", "cat_1_ID", "cat_1_name", "cat_2_ID", "cat_2_name"]

# The five segments, in display order.
SEGMENTS = ["Champions", "Loyal", "At-risk", "New", "Dormant"]

# Month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Reasons in the ingest report.
REASON_DATE = "unparseable date"
REASON_CUSTOMER = "missing customer id"
REASON_PRICE = "unparseable price"
REASON_CANCELLED = "cancellations / returns"
REASON_NONPOSITIVE = "non-positive price"
REASON_SHOP_MISSING = "missing customer / date / value"
REASON_SHOP_STRUCTURAL = "billing / shipping lines"
REASON_SHOP_STATUS = "cancelled / returned / failed"
# Our own reason: lines of a text file behind a quote that no line closes.
REASON_QUOTE = "behind an open quote"
SUSPICIOUS_REASONS = [REASON_DATE, REASON_PRICE, REASON_CUSTOMER, REASON_SHOP_MISSING,
                      REASON_QUOTE]

# Columns the clustering and lookalike operators run on; all but recency are log-damped.
MODEL_FEATURES = ["recency", "frequency", "monetary",
                  "avg_order_value", "avg_basket_items", "distinct_products"]
