"""Panel analytics and systematic equity research on PySpark."""
