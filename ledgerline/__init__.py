"""ledgerline: invoice line-item extraction and unit-of-measure analytics
as Spark DataFrame operators."""

__version__ = "0.1.0"
