"""Reading from and writing to topics, tables, trees and landed deliveries."""
