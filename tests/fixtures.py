"""The customers and orders of FIXTURES.md."""

from ledgerframe.engine import Engine
from ledgerframe.sources.catalog import Catalog

CUSTOMERS = [
    ("c1", "Alice", "London", True, 10, None),
    ("c2", "Bob", "Paris", False, 20, None),
    ("c3", "Cara", "London", True, 30, None),
    ("c4", "Dan", "Rome", False, 40, "D'Angelo"),
]
ORDERS = [("o1", "c1", 120), ("o2", "c1", 30), ("o3", "c2", 200), ("o4", "c3", 5), ("o5", "c3", 0), ("o6", "c4", 300)]
CUSTOMER_SCHEMA = "id string, name string, city string, active boolean, score int, nickname string"
ORDER_SCHEMA = "id string, customerId string, total int"


def engine(spark, customers=CUSTOMERS, orders=ORDERS) -> Engine:
    c = spark.createDataFrame(customers, CUSTOMER_SCHEMA)
    o = spark.createDataFrame(orders, ORDER_SCHEMA)
    catalog = Catalog().add("customers", c, "id", [x for x in c.columns if x != "id"]).add("orders", o, "id", ["customerId", "total"])
    return Engine(catalog)
