"""tidewatch: customer-risk analytics as plain Spark DataFrames.

Operators take and return DataFrames.  Statistics that an operator needs are
lazy one-row DataFrames that reach the rows through a scalar subquery, so a
whole feature plan stays one Catalyst plan and nothing is collected.
"""

__version__ = "0.1.0"
