"""ledgerloom: two-ledger reconciliation as PySpark DataFrame operators."""
