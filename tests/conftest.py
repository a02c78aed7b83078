import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerspark.model import TRANSACTION  # noqa: E402
from ledgerspark.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def money(value):
    return None if value is None else Decimal(value).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def make(spark):
    """Build transactions from short dicts."""

    def build(*rows):
        out = []
        for i, given in enumerate(rows, start=1):
            row = {
                "id": i,
                "transaction_date": dt.datetime(2001, 1, i if i < 28 else 28),
                "description": "Payment to shop",
                "debit": None,
                "credit": "100.00",
                "amount": "100.00",
                "balance": "100.00",
                "reference": None,
                "utr": None,
                "transaction_type": "Credit",
                "bank_code": 1,
                "account": None,
                "source_file_id": 1,
                "client_id": 1,
                "created_at": dt.datetime(2001, 2, 1),
                "seq": i,
                "value_date": None,
                "processing_warning": None,
                "defect": 10,
            } | given
            for name in ("debit", "credit", "amount", "balance"):
                row[name] = money(row[name])
            out.append(tuple(row[f.name] for f in TRANSACTION.fields))
        return spark.createDataFrame(out, TRANSACTION)

    return build
