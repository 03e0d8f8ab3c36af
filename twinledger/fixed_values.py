"""Names, phrases and limits that results are defined by.

Everything here is plain data. The operators read it through
:class:`twinledger.options.Options`, so each value can be overridden.
"""

from __future__ import annotations

# --- Fixed values: result labels and columns ---------------------------------

LEFT_LABEL = "MSPHub"
RIGHT_LABEL = "Microsoft"
LEFT_PREFIX = "Hub"
RIGHT_PREFIX = "MS"
LEFT_FEED_NAME = "MSP Hub invoice"
RIGHT_FEED_NAME = "Microsoft invoice"
VALIDATED_FEED_NAME = "MSPHubInvoice"

MATCHED = "Matched"
MISMATCHED = "Mismatched"
DATA_ERROR = "Data Error"

# --- Fixed values: canonical schema, in order --------------------------------

CANONICAL_COLUMNS = (
    "PartnerId", "CustomerId", "CustomerName", "CustomerDomainName", "CustomerCountry",
    "InvoiceNumber", "MpnId", "Tier2MpnId", "OrderId", "OrderDate", "ReferenceId",
    "ProductId", "SkuId", "AvailabilityId", "SkuName", "ProductName",
    "ChargeType", "UnitPrice", "Quantity", "Subtotal", "TaxTotal", "Total", "Currency",
    "PriceAdjustmentDescription",
    "PublisherName", "PublisherId", "SubscriptionDescription", "SubscriptionId",
    "ChargeStartDate", "ChargeEndDate", "TermAndBillingCycle", "EffectiveUnitPrice",
    "UnitType", "AlternateId", "BillableQuantity", "BillingFrequency", "PricingCurrency",
    "PCToBCExchangeRate", "PCToBCExchangeRateDate", "MeterDescription", "ReservationOrderId",
    "CreditReasonCode", "SubscriptionStartDate", "SubscriptionEndDate", "ProductQualifiers",
    "PromotionId", "ProductCategory", "Term", "BillingCycle",
)

# Columns moved to the front of an imported feed.
LEADING_COLUMNS = (
    "CustomerDomainName", "ProductId", "SkuId", "ChargeType", "Term", "BillingCycle", "ReferenceId",
)
RIGHT_LEADING_COLUMNS = LEADING_COLUMNS + ("TermAndBillingCycle", "BillingFrequency")

REQUIRED_RIGHT = ("CustomerDomainName", "ProductId", "SkuId", "ChargeType", "TermAndBillingCycle")
REQUIRED_LEFT = ("ReferenceId", "SkuId", "BillingCycle")

# --- Fixed values: column maps per source kind --------------------------------
# A rule is a source column name, a tuple of names (first non-empty wins),
# ("A", "B", "*") for a product, ("A", "B", "+", "C") for a product plus a
# column, or an arithmetic template with {column} placeholders. A canonical
# column without a rule stays blank.

MICROSOFT = "Microsoft"
PARTNER = "Partner"
DISTRIBUTOR = "Distributor"


def _same(*names: str) -> dict:
    return {name: name for name in names}


COLUMN_MAPS = {
    MICROSOFT: _same(*CANONICAL_COLUMNS),
    PARTNER: {
        **_same(
            "PartnerId", "CustomerId", "CustomerName", "CustomerDomainName", "CustomerCountry",
            "OrderDate", "ProductId", "SkuName", "ProductName", "ChargeType", "Quantity",
            "SubscriptionId", "PricingCurrency", "SubscriptionStartDate", "SubscriptionEndDate",
            "ProductQualifiers", "Term", "BillingCycle",
        ),
        "InvoiceNumber": "PartnerInvoiceNumber",
        "OrderId": "OrderNumber",
        "SkuId": ("PartNumber", "SkuName", "SkuId"),
        "UnitPrice": "PartnerUnitPrice",
        "Subtotal": "PartnerSubTotal",
        "TaxTotal": "PartnerTaxTotal",
        "Total": "PartnerTotal",
        "TermAndBillingCycle": ("Term", "BillingCycle"),
        "EffectiveUnitPrice": "PartnerEffectiveUnitPrice",
        "BillingFrequency": "BillingCycle",
        "ReferenceId": "InternalReferenceId",
    },
    DISTRIBUTOR: {
        **_same(
            "CustomerId", "CustomerDomainName", "OrderDate", "ProductId", "ProductName", "ChargeType",
            "UnitPrice", "Quantity", "SubscriptionId", "EffectiveUnitPrice", "BillingFrequency",
            "PricingCurrency", "SubscriptionStartDate", "SubscriptionEndDate", "ProductQualifiers",
            "Term", "BillingCycle",
        ),
        "CustomerName": "BillingSubscriptionName",
        "OrderId": ("OrderId", "OrderNumber"),
        "SkuId": "Sku",
        "SkuName": "Sku",
        "Subtotal": "{CustomerUnitPrice} * {Quantity}",
        "TaxTotal": "CustomerTax",
        "Total": "{Subtotal} + {CustomerTax}",
        "Currency": "PricingCurrency",
        "ChargeStartDate": "SubscriptionStartDate",
        "ChargeEndDate": "SubscriptionEndDate",
        "TermAndBillingCycle": "Term",
    },
}

# File name prefix -> source kind, compared in upper case.
FILE_PREFIXES = (
    ("G0", MICROSOFT),
    ("IND", PARTNER),
    ("BILLINGTRANSACTIONS_", DISTRIBUTOR),
)

# --- Fixed values: renames, aliases, required columns --------------------------

LEFT_RENAMES = (
    ("ResourceName", "ProductName"),
    ("ValidFrom", "ChargeStartDate"),
    ("ValidTo", "ChargeEndDate"),
    ("PurchaseDate", "OrderDate"),
    ("PartnerTotal", "Total"),
)

LEGACY_RENAMES = (
    ("PartnerUnitPrice", "UnitPrice"),
    ("PartnerEffectiveUnitPrice", "EffectiveUnitPrice"),
    ("MSRP", "MSRPPrice"),
)
LEGACY_STUBS = (
    "PartnerDiscountPercentage", "MSRPPrice", "EffectiveMSRPPrice", "AdminDiscountPercentage",
)
LEGACY_DATES = (
    "ValidFrom", "ValidTo", "OrderDate", "SubscriptionStartDate", "SubscriptionEndDate",
    "ChargeStartDate", "ChargeEndDate", "PurchaseDate",
)
LEGACY_KEYS = ("InvoiceNumber", "ChargeType", "Quantity")

# Ordered: earlier aliases win when several could fill the same target.
ALIASES = (
    ("SubscriptionGuid", "SubscriptionId"),
    ("SubId", "SubscriptionId"),
    ("CustomerName", "CustomerDomainName"),
    ("CustomerId", "CustomerDomainName"),
    ("DomainUrl", "CustomerDomainName"),
    ("ProductGuid", "ProductId"),
    ("MPNId", "ProductId"),
    ("PartNumber", "ProductId"),
    ("MSRP", "MSRPPrice"),
    ("BillableQuantity", "Quantity"),
)
COMPARED_COLUMNS = (
    "UnitPrice", "EffectiveUnitPrice", "Subtotal", "TaxTotal", "Total", "MSRPPrice", "Quantity",
    "SubscriptionId", "ProductId", "CustomerDomainName", "ChargeType", "ChargeStartDate",
)
UPPER_KEYS = ("CustomerDomainName", "ProductId", "ChargeType", "SubscriptionId")
COMPOSITE_KEYS = ("InvoiceNumber", "SkuId")

# Result view columns that may be hidden.
HIDDEN_COLUMNS = (
    "CustomerCountry", "MpnId", "AvailabilityId", "Currency", "PriceAdjustmentDescription",
    "PublisherName", "PublisherId", "ProductQualifiers", "ReferenceId", "MeterDescription",
    "PCToBCExchangeRateDate", "PCToBCExchangeRate", "PricingCurrency", "BillableQuantity",
    "AlternateId", "UnitType",
)

# --- Fixed values: column classes by name --------------------------------------

DATE_SUFFIXES = ("date", "dateutc", "time")
NUMERIC_NAMES = (
    "unitprice", "effectiveunitprice", "quantity", "subtotal", "taxtotal", "total", "priceadjustment",
)
NUMERIC_SUFFIXES = ("price", "total", "subtotal", "percentage", "quantity")

# --- Fixed values: usage-plan rows ----------------------------------------------

USAGE_PLAN = "Azure plan"
USAGE_PLAN_RIGHT_COLUMN = "SubscriptionDescription"
USAGE_PLAN_LEFT_COLUMN = "ProductName"

# --- Fixed values: commitment phrase -> (term, billing cycle) --------------------
# A billing cycle given as a pair means (when BillingFrequency is blank, otherwise).

TERMS = (
    ("One-Year commitment for monthly/yearly billing", "Annual", ("Annual", "Monthly")),
    ("One-Year commitment for yearly billing", "Annual", "Annual"),
    ("One-Month commitment for monthly billing", "Monthly", "Monthly"),
    ("1 Cache Instance Hour", "Monthly", "Monthly"),
    ("Three-3 Years commitment for monthly/3 Years/yearly billing", "Triennial", "Monthly"),
    ("", "None", "OneTime"),
)
OTHER_TERM = ("NA", "NA")

# --- Fixed values: friendly column labels -----------------------------------------

FRIENDLY_NAMES = {
    "SkuId": "Product Code",
    "ChargeEndDate": "Invoice Date",
    "CustomerDomainName": "Customer Website",
    "PartnerId": "Partner ID",
    "PartnerTaxTotal": "Partner Tax Amount",
    "PartnerSubTotal": "Subtotal",
    "PartnerTotal": "Total",
    "PartnerUnitPrice": "Unit Price",
}

# --- Fixed values: compared fields, data-quality columns, difference groups --------

TOTALS = ("Quantity", "Subtotal", "Total", "TaxTotal")
DIFF_FIELDS = ("UnitPrice", "Quantity", "Subtotal", "TaxTotal", "Total")

PRICED_COLUMNS = (
    "PartnerDiscountPercentage", "PartnerEffectiveUnitPrice", "CustomerUnitPrice",
    "CustomerPerDayUnitPrice", "CustomerEffectiveUnitPrice", "PartnerTaxTotal",
)
CRITICAL_COLUMNS = (
    "CustomerSubTotal", "EffectiveDays", "Quantity", "PartnerTotal", "PartnerDiscountPercentage",
    "CustomerDiscountPercentage",
)

MISSING_ROWS = "Missing Rows"
SUGGESTED_ACTIONS = {
    "Product Code mismatches": "Please verify the correct product was invoiced.",
    "Date mismatches": "Review and confirm correct invoice date.",
    "Quantity mismatches": "Investigate reason for quantity difference.",
}

INVOICE_CHECKS = {
    "days": "Eff. Days Validation",
    "partner_discount": "Partner Discount Validation",
    "hierarchy": "Discount Hierarchy Check",
    "pricing": "Pricing Consistency Check",
}
