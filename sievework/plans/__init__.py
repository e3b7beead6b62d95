"""The screening run: order of the parts, guard, gates, ledger and report."""
