"""Star schema: column types, keys and declared constraints."""

from __future__ import annotations

TABLE_NAMES = ("regions", "categories", "customers", "products", "orders", "order_items")

SCHEMAS: dict[str, str] = {
    "regions": "region_id int, region_name string, code string, country string",
    "categories": "category_id int, category_name string, description string",
    "customers": (
        "customer_id bigint, customer_code string, first_name string, last_name string, "
        "email string, segment string, city string, state string, country string"
    ),
    "products": (
        "product_id bigint, product_code string, product_name string, category_id int, "
        "unit_price decimal(20,2), cost_price decimal(20,2), sku string, is_active boolean"
    ),
    "orders": (
        "order_id bigint, order_number string, customer_id bigint, region_id int, "
        "order_date date, order_timestamp timestamp_ntz, payment_method string, "
        "order_status string, shipping_cost decimal(20,2), discount_amount decimal(20,2), "
        "total_amount decimal(38,2), is_synthetic boolean"
    ),
    "order_items": (
        "order_id bigint, product_id bigint, quantity bigint, unit_price decimal(20,2), "
        "discount_rate decimal(5,4), total_price decimal(20,2)"
    ),
    "data_import_logs": (
        "import_id bigint, filename string, file_type string, total_rows bigint, "
        "valid_records bigint, duplicate_rows bigint, missing_values_handled bigint, "
        "rejected_rows bigint, quality_score double, status string, audit_details string, "
        "created_at timestamp_ntz"
    ),
}


def column_types(table: str) -> list[tuple[str, str]]:
    return [tuple(column.split(" ")) for column in SCHEMAS[table].split(", ")]


# Declared keys and rules of the data model.
UNIQUE_KEYS = (
    ("categories", "category_id"),
    ("categories", "category_name"),
    ("customers", "customer_id"),
    ("customers", "customer_code"),
    ("orders", "order_id"),
    ("orders", "order_number"),
    ("products", "product_id"),
    ("products", "product_code"),
    ("regions", "region_id"),
    ("regions", "region_name"),
)
FOREIGN_KEYS = (
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("orders", "customer_id", "customers"),
    ("orders", "region_id", "regions"),
    ("products", "category_id", "categories"),
)
NOT_NULL_COLUMNS = {
    "categories": ("category_id", "category_name"),
    "regions": ("region_id", "region_name", "country"),
    "customers": ("customer_id", "customer_code", "first_name", "last_name", "email"),
    "products": (
        "product_id", "product_code", "product_name", "category_id", "unit_price", "cost_price"),
    "orders": (
        "order_id", "order_number", "customer_id", "region_id", "order_date", "order_timestamp",
        "payment_method", "order_status", "total_amount",
    ),
    "order_items": (
        "order_id", "product_id", "quantity", "unit_price", "total_price"),
}
REVENUE_STATUSES = ("Completed", "Shipped")
COMPLETED = "Completed"
TOP_TIER_SPEND = 5000
MIDDLE_TIER_SPEND = 1500
TIER_NAMES = ("High Spending (VIP)", "Medium Spending", "Low Spending")
VALUE_TIER_NAMES = ("VIP / High Value", "Mid-Tier Spender", "Casual Spender")
