"""Declared schemas of the raw, mart and log tables.

Fixed values: column names, their order and their types are the warehouse's data model, so that
files and queries written for it keep working.  Money carries 4 digits in raw tables and 2 in marts;
``location_id`` of an order header is a floating point number; several raw numbers are stored as text.
"""

RAW = {
    "country": """
        country_id bigint, country string, iso_currency string, iso_country string,
        city_id bigint, city string, city_population string""",
    "franchise": """
        franchise_id bigint, first_name string, last_name string, city string, country string,
        e_mail string, phone_number string""",
    "location": """
        location_id bigint, placekey string, location string, city string, region string,
        iso_country_code string, country string""",
    "menu": """
        menu_id bigint, menu_type_id bigint, menu_type string, truck_brand_name string,
        menu_item_id bigint, menu_item_name string, item_category string, item_subcategory string,
        cost_of_goods_usd decimal(18,4), sale_price_usd decimal(18,4),
        menu_item_health_metrics_obj string""",
    "truck": """
        truck_id bigint, menu_type_id bigint, primary_city string, region string, iso_region string,
        country string, iso_country_code string, franchise_flag bigint, year bigint, make string,
        model string, ev_flag bigint, franchise_id bigint, truck_opening_date date""",
    "order_header": """
        order_id bigint, truck_id bigint, location_id double, customer_id bigint, discount_id string,
        shift_id bigint, shift_start_time string, shift_end_time string, order_channel string,
        order_ts timestamp_ntz, served_ts string, order_currency string, order_amount decimal(18,4),
        order_tax_amount string, order_discount_amount string, order_total decimal(18,4)""",
    "order_detail": """
        order_detail_id bigint, order_id bigint, menu_item_id bigint, discount_id string,
        line_number bigint, quantity int, unit_price decimal(18,4), price decimal(18,4),
        order_item_discount_amount string""",
    "customer_loyalty": """
        customer_id bigint, first_name string, last_name string, city string, country string,
        postal_code string, preferred_language string, gender string, favourite_brand string,
        marital_status string, children_count string, sign_up_date date, birthday_date date,
        e_mail string, phone_number string""",
    "truck_reviews": """
        order_id bigint, language string, source string, review string, review_id bigint""",
}

MART = {
    "fact_daily_item_sales": """
        date date, menu_item_id string, menu_item_name string, truck_brand_name string,
        country string, location_id string, orders_count bigint, order_lines bigint,
        quantity bigint, gross_sales decimal(38,2), net_sales decimal(38,2),
        last_updated_at timestamp_ntz""",
    "kpi_daily_brand": """
        date date, truck_brand_name string, total_orders bigint, total_order_lines bigint,
        total_quantity bigint, total_sales decimal(38,2), avg_order_value decimal(38,2),
        unique_customers bigint, last_updated_at timestamp_ntz""",
    "sales_anomalies": """
        date date, grain string, id string, metric_name string, metric_value decimal(38,2),
        zscore decimal(38,6), robust_zscore decimal(38,6), anomaly_flag boolean, context string,
        detected_at timestamp_ntz""",
    "dq_results": """
        run_ts timestamp_ntz, check_name string, severity string, status string,
        failed_count bigint, sample_rows string, notes string""",
}
# --- end of fixed values ---


def names(ddl: str) -> list[str]:
    """Column names of a DDL string, in order."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
