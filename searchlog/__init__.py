"""searchlog: analysis of search-query logs as Spark DataFrame jobs.

Every operator takes DataFrames and parameters and returns a DataFrame; nothing is collected to the driver.
"""
