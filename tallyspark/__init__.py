"""tallyspark: store-sales analytics (cleaning, star schema, business queries,
marts, data quality, segmentation, forecasting, regression) as Spark jobs."""

__version__ = "0.1.0"
