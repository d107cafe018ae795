"""Account-ledger analytics as Spark DataFrame operators."""
