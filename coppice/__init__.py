"""Cross-validated decision trees and their building blocks as Spark DataFrame operators."""
