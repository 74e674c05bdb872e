"""Formloom: morphometric analytics on Spark DataFrames."""
