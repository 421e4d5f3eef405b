"""Spark-native engine for indexing text and source trees and asking questions of them in bulk."""
