from twinledger.operators.net_price import net_price_mismatches

H = "CustomerDomainName,ProductId,ChargeType,Quantity,Subtotal"


def test_equal_sides_give_nothing(table):
    side = table(H, ("c", "p", "Usage", "1", "5"))
    assert net_price_mismatches(side, side).count() == 0


def test_credit_and_debit_net_out(table):
    left = table(H, ("c", "p", "Usage", "1", "1"))
    right = table(H, ("C ", "P", "x", "-100", "0"), ("c", "p", "x", "101", "101"))
    row = net_price_mismatches(left, right).first()
    assert (row["QuantityDiff"], row["PriceDiff"], row["ChargeType"]) == (0, -100, "Usage")


def test_charge_types_listed_once_sorted(table):
    left = table(H, ("c", "p", "b", "1", "1"), ("c", "p", "a", "1", "1"), ("c", "p", "b", "1", "1"), ("c", "p", "", "1", "1"))
    row = net_price_mismatches(left, table(H, ("c", "p", "z", "1", "1"))).first()
    assert row["ChargeType"] == ", a, b" and row["HubQuantity"] == 4


def test_usage_plan_rows_are_left_out(table):
    left = table(H + ",ProductName", ("c", "p", "x", "1", "1", "AZURE PLAN"), ("c", "q", "x", "1", "1", "Seat"))
    right = table(H, ("c", "p", "x", "2", "2"), ("c", "q", "x", "2", "2"))
    assert [r["ProductId"] for r in net_price_mismatches(left, right).collect()] == ["Q"]
    only_plan = table(H + ",ProductName", ("c", "p", "x", "1", "1", "azure plan"))
    assert net_price_mismatches(only_plan, right).count() == 0


def test_key_fallbacks_and_left_shape(table):
    left = table("CustomerName,PartNumber,CustomerDomainName,ProductId,Quantity,Subtotal,Note", ("c", "p", " ", "", "1", "1", "n"))
    right = table(H, ("c", "p", "x", "2", "2"))
    row = net_price_mismatches(left, right, left_shape=True).first().asDict()
    assert row["CustomerDomainName"] == "C" and row["ProductId"] == "P"
    assert row["Note"] is None and row["CustomerName"] is None and row["QuantityDiff"] == -1
    assert "ChargeType" not in row
