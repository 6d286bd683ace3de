"""Hand-made logical tables for micro fixtures."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from anomalytics.sources.schemas import CUSTOMERS, ORDER_ITEMS, ORDER_PAYMENTS, ORDERS, PRODUCTS, SELLERS

BASE = dt.datetime(2018, 3, 4, 10, 0, 0)   # a Sunday


def order(oid, cust="c1", ts=BASE, status="delivered"):
    return (oid, cust, status, ts, ts, ts, ts, ts)


def item(oid, price, freight="0.00", product="p1", seller="s1", n=1):
    return (oid, n, product, seller, None, Decimal(str(price)), Decimal(str(freight)))


def payment(oid, ptype="credit_card", inst=1, value="0.00", seq=1):
    return (oid, seq, ptype, inst, Decimal(str(value)))


def customer(cid, state="SP", city="sao paulo", zip_="01000"):
    return (cid, cid + "-u", zip_, city, state)


def tables(spark, orders, items, payments=(), customers=(("c1", "c1-u", "01000", "sao paulo", "SP"),),
           products=(("p1", "toys"),), sellers=(("s1", "00000", "campinas", "SP"),)):
    return {
        "orders": spark.createDataFrame(list(orders), ORDERS),
        "order_items": spark.createDataFrame(list(items), ORDER_ITEMS),
        "order_payments": spark.createDataFrame(list(payments), ORDER_PAYMENTS),
        "customers": spark.createDataFrame(list(customers), CUSTOMERS),
        "products": spark.createDataFrame(list(products), PRODUCTS),
        "sellers": spark.createDataFrame(list(sellers), SELLERS),
    }
